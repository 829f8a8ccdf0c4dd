"""The logical tables (events, persons, locations, sources, mentions) and their adapters from the driver's tables.

Years are signed integers, negative before the common era; no date type reaches back far enough. The adapters use
integer arithmetic only, in text that Spark and other SQL engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADAPTERS = {
    "location": "SELECT n_nationkey AS id, n_name AS name, r_name AS country, CAST((n_nationkey * 37) % 171 - 85 AS DOUBLE) AS latitude, CAST((n_nationkey * 73) % 351 - 175 AS DOUBLE) AS longitude FROM nation JOIN region ON n_regionkey = r_regionkey",
    "event": "SELECT p_partkey AS id, p_name AS title, CAST((p_partkey * 7919) % 5001 - 3000 AS INT) AS date_start, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey * 7919) % 5001 - 3000 + p_size AS INT) END AS date_end, p_size % 5 + 1 AS importance, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 25 AS INT) END AS location_id, p_type AS category, p_brand AS brand FROM part",
    "person": "SELECT s_suppkey AS id, s_name AS name, CAST((s_suppkey * 613) % 4001 - 2500 AS INT) AS birth_year, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST((s_suppkey * 613) % 4001 - 2500 + s_suppkey % 90 AS INT) END AS death_year, s_nationkey AS nation_id FROM supplier",
    "source": "SELECT o_orderkey AS id, o_orderpriority AS type, o_orderstatus AS status FROM orders",
    "mention": "SELECT 'event' AS entity_type, l_partkey AS entity_id, l_orderkey AS source_id, 1 - l_discount AS confidence, l_linenumber AS chunk_index FROM lineitem UNION ALL SELECT 'person', l_suppkey, l_orderkey, 1 - l_discount, l_linenumber FROM lineitem",
}
_NEEDS = {"location": ("nation", "region"), "event": ("part",), "person": ("supplier",), "source": ("orders",), "mention": ("lineitem",)}

EVENT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("title", T.StringType()), T.StructField("date_start", T.IntegerType()), T.StructField("date_end", T.IntegerType()), T.StructField("importance", T.IntegerType()), T.StructField("location_id", T.IntegerType()), T.StructField("category", T.StringType())])
PERSON = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("birth_year", T.IntegerType()), T.StructField("death_year", T.IntegerType())])
LOCATION = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("country", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
MENTION = T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("entity_id", T.LongType()), T.StructField("source_id", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("chunk_index", T.IntegerType())])


class Tables:
    """t.event, t.person, ... and the raw tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            return self.spark.sql(_braced(ADAPTERS[name], _NEEDS[name]), **{n: self._raw(n) for n in _NEEDS[name]})
        return self._raw(name)

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def mentions(self, entity_type: str) -> DataFrame:
        """entity_id, source_id of one type; the other branch of the union is pruned."""
        return self.mention.filter(F.col("entity_type") == entity_type).select("entity_id", "source_id", "confidence", "chunk_index")


def _braced(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def with_adapters(sql: str) -> str:
    """An oracle's SQL with the logical tables that it names."""
    used = [n for n in ADAPTERS if __import__("re").search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes},\n{body[len('WITH'):]}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"

"""Readers. Every one takes a schema, so none scans its input to infer one."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Loader(Protocol):
    """What a collector of an outside service has to offer."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def json_array(spark: SparkSession, *paths: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON array, as one table."""
    return spark.read.schema(schema).json(list(paths), multiLine=True)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "DROPMALFORMED") -> DataFrame:
    return spark.read.schema(schema).json(path, mode=bad)


def envelopes(lines: DataFrame, value: str, schema: str) -> DataFrame:
    """Batch answers of a language model: the content of the first choice is JSON text itself. Unreadable ones are left out."""
    content = F.get_json_object(value, "$.response.body.choices[0].message.content")
    return lines.select(F.get_json_object(value, "$.custom_id").alias("custom_id"), F.from_json(content, schema).alias("record")).filter("record is not null").select("custom_id", "record.*")


def tsv_first_wins(spark: SparkSession, path: str, schema: T.StructType | str, name: str, order: str) -> DataFrame:
    """Tab-separated rows, the first of each lower-cased name."""
    rows = spark.read.schema(schema).csv(path, sep="\t", quote="")
    names = [c for c in rows.columns]
    first = rows.groupBy(F.lower(F.trim(name)).alias("name_normalized")).agg(F.min_by(F.struct(*names), order).alias("r"))
    return first.select("name_normalized", "r.*")


def json_ld_names(spark: SparkSession, path: str) -> DataFrame:
    """id, title, latitude, longitude, name of a JSON-LD gazetteer: a row per title and per other name."""
    schema = "`@graph` array<struct<id:string,title:string,reprPoint:array<double>,names:array<struct<romanized:string,attested:string>>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("@graph").alias("g"))
    names = F.array_distinct(F.filter(F.flatten(F.array(F.array("g.title"), F.transform("g.names", lambda n: n["romanized"]), F.transform("g.names", lambda n: n["attested"]))), lambda n: n.isNotNull() & (n != "")))
    names = F.coalesce(names, F.array("g.title"))
    return each.select("g.id", "g.title", F.get("g.reprPoint", F.lit(1)).alias("latitude"), F.get("g.reprPoint", F.lit(0)).alias("longitude"), F.explode(names).alias("name"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

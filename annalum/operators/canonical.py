"""A map of canonical names that grows while names are read, in batches, as versions.

One by one, a name is resolved against the map as it is then: by its normal form, if a canonical name or an alias has it;
else by its outside key, if a canonical name has that; else it becomes canonical, with its key. What matches by key
becomes an alias, so later names of its normal form follow it.

Batches give the same result without reading one by one. Of the names of one normal form only the first, by id, can
change the map: the others follow it. And of these firsts that share a key, the first new one registers it, and the
others match it. So a batch is two groupings, by normal form and by key, each against the map first. The result is that
of the order of ids, and does not depend on how names are cut into batches as long as batches follow the ids.

Every batch is a version of the map and of its resolutions, numbered and published by one rename: a batch that comes
again, or whose writer was lost, gives the same map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.functions import text
from annalum.sources import shared
from annalum.sources.sinks import finished, history_of, publish_all

FORMS, KEYS, RESOLVED = "form string, canonical_id long", "key string, canonical_id long", "id long, canonical_id long, method string, confidence double"


def normal_form(name: Column) -> Column:
    """Without title, suffix, 'le Fay' and 'du Lac'; null for a blank name."""
    bare = F.regexp_replace(F.regexp_replace(text.plain_name(name), r"\s+le\s+fay$", ""), r"\s+du\s+lac$", "")
    return F.nullif(F.trim(bare), F.lit(""))


def _all(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    found = history_of(spark, path, name)
    return spark.createDataFrame([], schema) if found is None else found


def resolutions(spark: SparkSession, path: str) -> DataFrame:
    """id, canonical_id, method (rule, key, new), confidence (0.9, 0.95, 0.5) of every name so far."""
    return _all(spark, path, "resolved", RESOLVED)


def add_batch(names: DataFrame, path: str, number: int) -> bool:
    """Resolves names (id, name, key) as version `number` of the map at path; False if it is there. Ids are unique and above
    those of earlier batches. A null or blank name is its own canonical name and follows nobody."""
    spark = names.sparkSession
    if finished(spark, f"{path}/v{number:09d}/resolved"):
        return False
    forms, keys = _all(spark, path, "forms", FORMS), _all(spark, path, "keys", KEYS)
    own = shared.kept(names.select("id", normal_form(F.col("name")).alias("form"), F.nullif("key", F.lit("")).alias("key")), "names")
    first = own.filter("form is not null").groupBy("form").agg(F.min(F.struct("id", "key")).alias("f")).select("form", F.col("f.id").alias("first_id"), F.col("f.key").alias("key"))
    known = first.join(forms.withColumnRenamed("canonical_id", "by_form"), "form", "left")
    heads = known.filter("by_form is null").select("form", "first_id", "key")
    by_key = heads.filter("key is not null").groupBy("key").agg(F.min("first_id").alias("new_id")).join(keys.withColumnRenamed("canonical_id", "known_id"), "key", "left")
    owner = F.coalesce("known_id", "new_id", "first_id")
    placed = shared.kept(heads.join(by_key, "key", "left").select("form", "first_id", "key", owner.alias("canonical_id")), "heads")
    of_form = known.filter("by_form is not null").select("form", F.col("by_form").alias("canonical_id"), F.lit(None).cast("long").alias("first_id"))
    of_form = of_form.unionByName(placed.select("form", "canonical_id", "first_id"))
    met = own.join(of_form, "form", "left")
    head = F.col("id") == F.col("first_id")
    method = F.when(F.col("form").isNull(), "new").when(F.coalesce(head, F.lit(False)), F.when(F.col("canonical_id") == F.col("id"), "new").otherwise("key")).otherwise("rule")
    done = met.select("id", F.coalesce("canonical_id", "id").alias("canonical_id"), method.alias("method"))
    confidence = F.when(F.col("method") == "rule", 0.9).when(F.col("method") == "key", 0.95).otherwise(0.5)
    registered = placed.filter("canonical_id = first_id and key is not null").select("key", "canonical_id")
    publish_all({"forms": placed.select("form", "canonical_id"), "keys": registered, "resolved": done.withColumn("confidence", confidence)}, path, number)
    return True


def resolve_all(names: DataFrame, path: str, batches: int) -> DataFrame:
    """All names in `batches` batches by ranges of ids; goes on where an earlier run ended."""
    spark = names.sparkSession
    low, high = names.agg(F.min("id"), F.max("id")).first()
    if low is not None:
        width = (high - low) // batches + 1
        for n in range(batches):
            add_batch(names.filter(F.col("id").between(low + n * width, low + (n + 1) * width - 1)), path, n + 1)
    return resolutions(spark, path)

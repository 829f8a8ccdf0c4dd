"""Decisions about names as a stream: mentioned, decided or pending, resolved; resumable at any point.

Every batch of mentions becomes one version of the log, numbered by the batch: decisions, pending rows and new registry
entries together, which one rename makes visible. A batch that Spark repeats after a failure finds its version there and
changes nothing; one that broke off before the rename left nothing and is decided again, from the same state. Mentions
whose key an earlier version has are passed over, so a mention that comes twice counts once.

A name that the registry holds, in lower case and trimmed, links to its owner. Otherwise a name that is alike to registered
ones (ratio of LIKE or more) is pending with the best of them; any other creates an entry, and equal new names of a batch
link to the first of them. Pending rows are resolved by later versions of a second log, in the same manner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.operators import similar_strings
from annalum.operators.joins import first_columns
from annalum.sources import shared
from annalum.sources.sinks import finished, history_of, publish_all, unprocessed

LIKE = 0.85
REGISTRY, DECISIONS = "name string, owner_id long", "mention_id long, name string, decision string, owner_id long, ratio double"


def _or_empty(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    found = history_of(spark, path, name)
    return spark.createDataFrame([], schema) if found is None else found


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, owner_id of everything registered so far."""
    return _or_empty(spark, f"{path}/log", "registry", REGISTRY)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """mention_id, name, decision (LINK, PENDING, CREATE), owner_id, ratio of every mention so far."""
    return _or_empty(spark, f"{path}/log", "decisions", DECISIONS)


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Decisions that wait: pending and not resolved."""
    done = _or_empty(spark, f"{path}/resolved", "resolved", DECISIONS)
    return unprocessed(decisions(spark, path).filter("decision = 'PENDING'"), done, "mention_id")


def decided(batch: DataFrame, known: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """(decisions, new registry entries) of a batch (mention_id, name) against a registry. Null and blank names are
    CREATE without an owner and are not registered."""
    key = F.lower(F.trim("name"))
    own = batch.select("mention_id", F.nullif(key, F.lit("")).alias("name"))
    first = own.filter("name is not null").groupBy("name").agg(F.min("mention_id").alias("first_id"))
    met = first.join(known.groupBy("name").agg(F.min("owner_id").alias("known_id")), "name", "left")
    fresh = shared.kept(met.filter("known_id is null").select("name", "first_id"), "fresh-names")
    alike = similar_strings.similar(fresh.select(F.col("name").alias("s")), known.select(F.col("name").alias("s")), like)
    owners = known.groupBy("name").agg(F.min("owner_id").alias("near_id"))
    ranked = alike.join(owners.withColumnRenamed("name", "b_s"), "b_s").withColumn("minus", -F.col("ratio"))
    best = first_columns(ranked, ["a_s"], ["minus"], ["near_id"]).withColumnRenamed("a_s", "name")
    ratio = ranked.groupBy(F.col("a_s").alias("name")).agg(F.max("ratio").alias("ratio"))
    judged = shared.kept(fresh.join(best, "name", "left").join(ratio, "name", "left"), "judged-names")
    named = own.join(met.select("name", "known_id"), "name", "left").join(judged, "name", "left")
    decision = F.when(F.col("known_id").isNotNull(), "LINK").when(F.col("near_id").isNotNull(), "PENDING").when(F.col("mention_id") > F.col("first_id"), "LINK").otherwise("CREATE")
    owner = F.coalesce("known_id", "near_id", "first_id")
    entries = judged.filter("near_id is null").select("name", F.col("first_id").alias("owner_id"))
    return named.select("mention_id", "name", decision.alias("decision"), owner.alias("owner_id"), "ratio"), entries


def take(batch: DataFrame, number: int, path: str, like: float = LIKE) -> bool:
    """Decides a batch as version `number` (from 1) of the log; False if the log has it."""
    spark = batch.sparkSession
    if finished(spark, f"{path}/log/v{number:09d}/decisions"):
        return False
    before = decisions(spark, path)
    new = unprocessed(batch.select("mention_id", "name").filter("mention_id is not null").dropDuplicates(["mention_id"]), before, "mention_id")
    made, entries = decided(shared.kept(new, "mentions"), registry(spark, path), like)
    publish_all({"decisions": made, "registry": entries}, f"{path}/log", number)
    return True


def follow(stream: DataFrame, path: str, like: float = LIKE):
    """A stream of (mention_id, name) into the log at path, whatever is there now."""
    each = lambda batch, n: take(batch, n + 1, path, like)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def resolve(answers: DataFrame, path: str) -> int:
    """Answers (mention_id, accepted) for pending rows, as the next version: accepted ones link to what was found, others
    create. Answers for what does not wait are passed over. Returns the version."""
    spark = answers.sparkSession
    given = answers.filter("mention_id is not null").groupBy("mention_id").agg(F.min("accepted").alias("accepted"))
    met = pending(spark, path).join(given, "mention_id")
    owner = F.when(F.col("accepted"), F.col("owner_id")).otherwise(F.col("mention_id"))
    done = met.select("mention_id", "name", F.when(F.col("accepted"), "LINK").otherwise("CREATE").alias("decision"), owner.alias("owner_id"), "ratio")
    return publish_all({"resolved": done}, f"{path}/resolved")

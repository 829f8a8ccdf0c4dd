"""Per-group orderings: neighbours, top-n, sessions, moving averages. Every order ends with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark limits groups before the shuffle, so a large group moves n rows a task."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def consecutive(df: DataFrame, by: str, order: list[str], carry: list[str]) -> DataFrame:
    """Each row with the next of its group: <c>_a and <c>_b for the columns carried."""
    w = W.partitionBy(by).orderBy(*order)
    both = df.select(by, *[F.col(c).alias(f"{c}_a") for c in carry], *[F.lead(c).over(w).alias(f"{c}_b") for c in carry])
    return both.filter(F.col(f"{carry[0]}_b").isNotNull())


def keep_best(df: DataFrame, by: list[str], score: Column, key: str) -> DataFrame:
    """Each group's row of the highest score, the smallest key of equals; with the group's size."""
    w = W.partitionBy(*by)
    return df.select("*", F.count("*").over(w).alias("group_size"), F.row_number().over(w.orderBy(score.desc(), F.asc(key))).alias("_nth")).filter("_nth = 1").drop("_nth")


def unique_slugs(df: DataFrame, base: str, key: str) -> DataFrame:
    """The base itself for the first row, base-1, base-2, ... for those after it."""
    nth = F.row_number().over(W.partitionBy(base).orderBy(key)) - 1
    return df.withColumn("slug", F.when(nth == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), nth.cast("string"))))


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_average", F.avg(value).over(w))


def durations(df: DataFrame, by: list[str], time: str, key: str, work: str) -> DataFrame:
    """Microseconds since the group's row before, and work per second; null where there is none or no time passed."""
    w = W.partitionBy(*by).orderBy(time, key)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("micros", at - F.lag(at).over(w)).withColumn("rate", F.when(F.col("micros") > 0, F.col(work) * 1e6 / F.col("micros")))


def hourly_count(df: DataFrame, by: str, time: str, limit: int, hours: int = 1) -> DataFrame:
    """How many rows of the group the last hours hold, itself included, and whether that is over the limit."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    w = W.partitionBy(by).orderBy(seconds).rangeBetween(-(3600 * hours - 1), 0)
    return df.withColumn("recent", F.count("*").over(w)).withColumn("refused", F.col("recent") > limit)


def anchored_batches(df: DataFrame, by: str, year: str, key: str, gap: int) -> DataFrame:
    """Batches of a group in order of year: a new one starts when a row is more than `gap` after the batch's first.

    That depends on where the batch began, not on the row before. Years are few: batches are found on each group's
    distinct years, folded in one array, and rows look their year up, so no group of rows meets in one task.
    """
    steps = df.filter(F.col(year).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(F.col(year).cast("long"))).alias("ys"))
    start = F.struct(F.lit(None).cast("long").alias("first"), F.array().cast("array<struct<y:bigint,f:bigint>>").alias("out"))
    def step(acc: Column, y: Column) -> Column:
        first = F.when(acc["first"].isNull() | (y - acc["first"] > gap), y).otherwise(acc["first"])
        return F.struct(first.alias("first"), F.concat(acc["out"], F.array(F.struct(y.alias("y"), first.alias("f")))).alias("out"))
    table = steps.select(by, F.explode(F.aggregate("ys", start, step)["out"]).alias("p")).select(F.col(by).alias("_by"), F.col("p.y").alias("_y"), F.col("p.f").alias("batch_start"))
    return df.join(table, df[by].eqNullSafe(F.col("_by")) & (df[year] == F.col("_y"))).drop("_by", "_y")

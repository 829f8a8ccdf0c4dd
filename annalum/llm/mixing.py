"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a target number of words; every document of it is expected target / size-of-source times. The
documents of a source stand in a row, by size and then by id; their expected copies are prefix-summed, one random
offset per source is added, and a document is emitted once for every integer that its interval crosses. Standing
by size makes the sample a stratified one, so the words taken come near the target, not only the copies.

The prefix sum is not a window over a source, which may hold a third of all rows. Rows are counted per (source,
size), with pre-aggregation; offsets of these buckets are summed over the table of counts, which has a row per distinct
size of a source, and only the rows of one bucket are numbered together. A bucket of more than `bucket_rows` rows (a
2000th of all, LEAST_BUCKET at least) is split by ranges of doc_id, whose bounds come from a sample: they decide which task
numbers a row, not its number.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ...; they share all words by weight, none above `cap`
times its own size. That is a water level: with sources in the order of cap / weight, those that reach the cap come
first. The table of sources has one row per source and is the only thing that one task sees as a whole.

Defined results: a null text has size 0, an empty source of size 0 takes nothing, a null source is a source of its
own, ties in size go by doc_id, null last, rows repeated in full are separate documents, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.llm.common import hex_hash, join_hot, read, small, word_count, written

WEIGHTS, CAP, SEED, LEAST_BUCKET, BUCKETS, SAMPLE = (1, 2, 3), 3, "mix", 128, 2000, 16


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """no_source, src, source_size -> the same with target. One row per source."""
    cycle = F.expr(f"array({','.join(f'{w}L' for w in weights)})")
    placed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(W.orderBy("no_source", "src")) - 1) % len(weights) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") * cap / F.col("weight"), "no_source", "src").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = placed.select(
        "*", F.coalesce(F.sum(F.col("source_size") * cap).over(order), F.lit(0)).alias("full"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(order), F.lit(0))).alias("left_weight"), F.sum("source_size").over(all_rows).alias("total"))
    level = level.withColumn("height", (F.col("total") - F.col("full")) / F.col("left_weight"))
    # Heights rise while the sources before are full, and fall once a source that is not full counts as full.
    level = level.withColumn("level", F.max("height").over(all_rows))
    return level.select("no_source", "src", "source_size", F.least(F.col("source_size") * cap, F.col("level") * F.col("weight")).cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, bucket_rows: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    size = word_count(F.col("text"))
    rows = written(docs.select("doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), size.alias("size")), "mix-sizes")
    total = max(1, rows.count())
    bucket_rows = bucket_rows or max(LEAST_BUCKET, total // BUCKETS)
    keys = ["no_source", "src", "size"]
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("subs", F.ceil(F.col("n") / bucket_rows).cast("long")), "mix-counts")
    # At most total / bucket_rows of them are split.
    some = rows.join(F.broadcast(sizes.filter("subs > 1")), keys).filter(F.col("doc_id").isNotNull() & (hex_hash(F.col("doc_id")) % F.col("n") < SAMPLE * F.col("subs")))
    ids = some.groupBy(*keys).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    cuts = ids.filter(F.size("ids") >= SAMPLE).select(*keys, F.expr(f"transform(sequence({SAMPLE}, size(ids), {SAMPLE}), i -> ids[i - 1])").alias("cuts"))
    sizes = written(sizes.join(F.broadcast(cuts), keys, "left"), "mix-sizes-cut")
    by_source = targets(sizes.groupBy("no_source", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    by_source = by_source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    by_source = written(by_source, "mix-targets")

    bucketed = join_hot(rows, sizes.select(*keys, "n", "cuts"), keys, "n", total)
    below = F.when(F.col("doc_id").isNull(), F.size("cuts")).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("doc_id"))))
    bucketed = bucketed.withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(below))
    bucket = [*keys, "sub"]
    counts = bucketed.groupBy(*bucket).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("no_source", "src").orderBy("size", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = counts.select(*bucket, before.alias("before")).join(small(by_source), ["no_source", "src"])
    place = F.row_number().over(W.partitionBy(*bucket).orderBy(F.asc_nulls_last("doc_id")))
    ranked = bucketed.select("doc_id", "source", *bucket, place.alias("place")).join(begin, bucket).withColumn("rank", F.col("before") + F.col("place"))
    offset = hex_hash(F.concat(F.lit(f"{seed}:"), F.col("src"))) / F.lit(4294967296.0)
    copies = F.floor(F.col("rate") * F.col("rank") + offset) - F.floor(F.col("rate") * (F.col("rank") - 1) + offset)
    out = ranked.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it. Rows that share id, source and size stand side by side
    in the mix's order and are dealt their copies round, in the order of their texts."""
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("times"), F.count("*").alias("rows"))
    name = _free(docs)
    times = taken.filter("times > 0").select(*[F.col(c).alias(f"{name}_{c}") for c in ("doc_id", "source", "size", "times", "rows")])
    sized = docs.withColumn(f"{name}_n", word_count(F.col("text")))
    same = docs["doc_id"].eqNullSafe(F.col(f"{name}_doc_id")) & docs["source"].eqNullSafe(F.col(f"{name}_source")) & (F.col(f"{name}_n") == F.col(f"{name}_size"))
    found = sized.join(times, same)
    alone = found.filter(f"{name}_rows = 1").withColumn(f"{name}_nth", F.lit(1))
    nth = F.row_number().over(W.partitionBy("doc_id", "source", f"{name}_size").orderBy("text"))
    found = alone.unionByName(found.filter(f"{name}_rows > 1").withColumn(f"{name}_nth", nth))
    share = F.floor((F.col(f"{name}_times") + F.col(f"{name}_rows") - F.col(f"{name}_nth")) / F.col(f"{name}_rows")).cast("int")
    dealt = found.select(*docs.columns, share.alias(f"{name}_share")).filter(f"{name}_share > 0")
    return dealt.withColumn(f"{name}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{name}_share")))).select(*docs.columns)


def _free(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    name = "_mix"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
g AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1] AS weight FROM g),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * {CAP}) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS height
      FROM s WINDOW o AS (ORDER BY source_size * {CAP} / weight::DOUBLE, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max(height) AS level FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
      FROM (SELECT no_source, src, source_size, least((source_size * {CAP})::DOUBLE, level * weight) AS target FROM l, v)),
r AS (SELECT doc_id, no_source, src, size, row_number() OVER (PARTITION BY no_source, src ORDER BY size, doc_id) AS rank FROM d),
u AS (SELECT no_source, src, ('0x' || substr(md5('{SEED}:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t)
SELECT doc_id, size, source_size, target, (size * (floor(rate * rank + u) - floor(rate * (rank - 1) + u)))::BIGINT AS taken
FROM r JOIN t USING (no_source, src) JOIN u USING (no_source, src)
"""

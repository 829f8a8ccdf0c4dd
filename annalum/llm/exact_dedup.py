"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. Every document becomes an entry (id, 64-bit hash of its text, SHA-256), written to the shared folder.
2. The directory starts with one bit of the hash; while a bucket has more distinct keys than its capacity,
   the directory doubles and that bucket splits. Only counts by hash prefix (2^16 at most) reach the driver.
   Buckets at the last depth may stay overfull: their owners spill, nothing is cut off.
3. Owner tasks get ranges of buckets, that is of keys, and write the index: its files tell which keys occur more
   than once.
4. Texts under such a key go to the owner of its bucket. Map tasks fold equal texts first, apart in SALTS parts, so
   that a text that a third of all rows share reaches its owner as a few partial links. The owner sorts a key's
   partial links into a chain, compares the bytes of neighbours and closes a link where they differ: texts that
   collide under one key become separate links. It writes every link's verdict: who stays, and how many rows it has.
5. Entries look their link up. Links large enough to skew that join are few by pigeonhole; they are broadcast.

Defined results: a null text counts as empty; a null doc_id loses to any other; rows repeated in full count as
copies of each other and exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.llm.common import join_hot, read, small, text_or_empty, without, written

DEEPEST, CAPACITY, SALTS = 16, 8192, 16


def directory(counts: dict[int, int], capacity: int, deepest: int = DEEPEST) -> list[int]:
    """The local depth of the bucket of every prefix of `deepest` bits; counts: distinct keys by such prefix."""
    depth = [1] * (1 << deepest)
    todo = [(0, 1), (1, 1)]
    while todo:
        prefix, d = todo.pop()
        low, high = prefix << (deepest - d), (prefix + 1) << (deepest - d)
        inside = sum(counts.get(p, 0) for p in range(low, high)) if counts else 0
        if inside > capacity and d < deepest:
            todo += [(2 * prefix, d + 1), (2 * prefix + 1, d + 1)]
        else:
            depth[low:high] = [d] * (high - low)
    return depth


def with_bucket(keys: DataFrame, depth: list[int]) -> DataFrame:
    """keys with the number of their bucket: its prefix, then a one and zeros, so that buckets are in the order of
    their keys and depths are told apart. The directory has as many entries as its deepest bucket asks for."""
    bits = max(depth)
    entries = depth[:: 1 << (DEEPEST - bits)]
    at = F.shiftrightunsigned("key", 64 - bits).cast("int")
    local = F.element_at(F.expr(f"array({','.join(map(str, entries))})"), at + 1)
    keys = keys.withColumns({"at": at, "depth": local})
    return keys.withColumn("bucket", F.expr(f"shiftleft(2 * shiftright(at, {bits} - depth) + 1, {bits} - depth)")).drop("at", "depth")


def build(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, list[int]]:
    """The entries, the index (bucket, key, n), both written to the shared folder, and the directory."""
    text = text_or_empty()
    entries = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256")), "dedup-entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    counted = keys.groupBy(F.shiftrightunsigned("key", 64 - DEEPEST).alias("p")).count().collect()
    depth = directory({r["p"]: r["count"] for r in counted}, capacity)
    owned = with_bucket(keys, depth).repartitionByRange(owners(depth), "bucket").sortWithinPartitions("bucket", "key")
    return entries, written(owned, "dedup-index"), depth


def owners(depth: list[int], most: int = 4096) -> int:
    """One task a bucket; above `most` a task owns several."""
    return min(most, sum(1 for i, d in enumerate(depth) if i % (1 << (DEEPEST - d)) == 0))


def links(docs: DataFrame, index: DataFrame, depth: list[int]) -> DataFrame:
    """bucket, key, link, text_sha256, keep_id, group_size: the owners' verdict on every text under a key that occurs
    more than once."""
    chained = index.filter("n > 1").select("key")
    text = text_or_empty()
    found = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text")).join(small(chained), "key", "left_semi")
    folded = found.groupBy("key", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    owned = with_bucket(folded, depth).repartitionByRange(owners(depth), "bucket")
    chain = W.partitionBy("bucket", "key").orderBy("text")
    opens = (~F.lag("text").over(chain).eqNullSafe(F.col("text"))).cast("int")
    closed = owned.withColumn("opens", opens).withColumn("link", F.sum("opens").over(chain))
    digest = F.max(F.when(F.col("opens") == 1, F.sha2("text", 256)))  # once a link
    return closed.groupBy("bucket", "key", "link").agg(digest.alias("text_sha256"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    entries, index, depth = build(docs, capacity)
    found = written(links(docs, index, depth).filter("group_size > 1").drop("bucket", "link"), "dedup-links")
    total, keys = max(1, entries.count()), ["key", "text_sha256"]
    # Of a link's rows the one with keep_id stays; of several with that id the first entry.
    mine = join_hot(entries, found, keys, "group_size", total).filter(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = written(mine.groupBy(*keys).agg(F.min("row").alias("keep_row"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "dedup-stays")
    joined = join_hot(entries, stays, keys, "group_size", total)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each group of equal texts: that of the largest doc_id."""
    verdicts = written(exact_dedup(docs, capacity), "dedup-verdicts")
    seen = verdicts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    gone = seen.filter("k = 0 and doc_id is not null")
    mixed = seen.filter("n > 1 and (k > 0 or doc_id is null)").select("doc_id")  # an id on several rows: look at the texts
    clear = without(docs, gone)
    if mixed.isEmpty():
        return clear
    text = text_or_empty()
    some = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["doc_id"]), "left_semi").withColumn("_sha", F.sha2(text, 256))
    stay = verdicts.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_s")).distinct()
    some = some.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_s")), "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return clear.join(mixed, clear["doc_id"].eqNullSafe(mixed["doc_id"]), "left_anti").unionByName(some.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

"""A stored BM25 index: postings by ranges of terms, in blocks with bounds, in segments that only ever are added.

A segment is a batch of documents, dealt by a hash of their keys into blocks of about BLOCK documents. Of every term and
block there is one row: the largest frequency, the smallest document length, the number of documents, and the postings
themselves. Rows are sorted by term over the files of a segment, so a query's terms are found by the statistics in the
files, and the numbers before the postings are read without them. From them comes the most that a document of a
block can score, as a score grows with the frequency and falls with the length.

A query reads the bounds of its terms, scores the documents of the FIRST blocks of highest bound, takes the k-th
score as its threshold, and then reads the postings of those blocks alone whose bound reaches it. The result is exact.

Texts are cut into tokens once, where they are read; what is shuffled are counts of terms by document.

Adding is repeatable: documents whose key the index has are passed over, so a batch that is added again changes
nothing, and one that broke off is not seen, for a segment counts once its totals are written, which come last. Keys
are unique; a batch that repeats one is an error. A null text is an empty document; a row without a key is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.operators.search import B, K1
from annalum.sources import shared
from annalum.sources.sinks import children, finished

BLOCK, FIRST = 1024, 8
#: Scores that differ by less are equal: the threshold is lowered by it.
SLACK = 1e-6


@dataclass(frozen=True)
class Reading:
    """What a search has read: rows of bounds, and postings of the blocks that it kept, out of all of its terms."""

    blocks: int
    blocks_kept: int
    postings: int
    postings_kept: int


_RUNS = re.compile("[a-z]+"), re.compile("[\uac00-\ud7af]+"), re.compile("[\u3040-\u30ff\u4e00-\u9fff]+")


def tokens(low: str) -> list[str]:
    """Of a text in lower case what functions.text.tokens gives: runs of a-z; of Hangul and of Kana and Han, each run's pairs
    and the run."""
    out = _RUNS[0].findall(low)
    for runs in _RUNS[1:]:
        for run in runs.findall(low):
            out += [run[i : i + 2] for i in range(len(run) - 1)]
            out.append(run)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, low) -> (key, block, term, tf, doc_length): a row per term of a document, and one with a null term."""
    for batch in batches:
        rows, terms, tf, lengths = [], [], [], []
        for i, low in enumerate(batch.column(2).to_pylist()):
            found = tokens(low)
            counts = Counter(found)
            rows += [i] * (len(counts) + 1)
            terms += [None, *counts]
            tf += [0, *counts.values()]
            lengths += [len(found)] * (len(counts) + 1)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(lengths, pa.int64())], ["key", "block", "term", "tf", "doc_length"])


def _gain(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-12)))


@dataclass(frozen=True)
class Bm25Index:
    """The index in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def _segments(self) -> list[str]:
        return [f"{self.path}/{name}" for name in children(self.spark, self.path) if finished(self.spark, f"{self.path}/{name}/totals")]

    def _read(self, part: str) -> DataFrame | None:
        found = self._segments()
        if not found:
            return None
        # A block's number counts within its segment.
        tables = [self.spark.read.parquet(f"{s}/{part}").withColumn("segment", F.lit(i)) for i, s in enumerate(found)]
        return reduce(DataFrame.unionByName, tables)

    def add(self, docs: DataFrame, key: str, body: Column, block: int = BLOCK) -> int:
        """Adds documents as a segment; returns how many were new."""
        own = docs.select(F.col(key).alias("key"), F.coalesce(body, F.lit("")).alias("body")).filter("key is not null")
        known = self._read("keys")
        if known is not None:
            own = own.join(known.select("key"), "key", "left_anti")
        if not own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError("keys repeat within the documents that are added")
        n = own.count()
        if not n:
            return 0
        dealt = own.select("key", F.pmod(F.xxhash64("key"), F.lit(-(-n // block))).cast("int").alias("block"), F.lower("body").alias("low"))
        kind = own.schema["key"].dataType.simpleString()
        each = shared.kept(dealt.mapInArrow(_counted, f"key {kind}, block int, term string, tf long, doc_length long"), "term-counts")
        at = f"{self.path}/{len(children(self.spark, self.path)):06d}-{shared.unique()[:8]}"
        rows = each.filter("term is not null").groupBy("term", "block").agg(
            F.max("tf").alias("max_tf"), F.min("doc_length").alias("min_length"), F.count("*").alias("n"),
            F.array_sort(F.collect_list(F.struct("key", "tf", "doc_length"))).alias("docs"))  # of one block: about `block`
        rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{at}/postings")
        each.filter("term is null").select("key", "doc_length").write.parquet(f"{at}/keys")
        self.spark.read.parquet(f"{at}/keys").agg(F.count("*").alias("docs"), F.sum("doc_length").cast("long").alias("tokens")).coalesce(1).write.parquet(f"{at}/totals")
        return n

    def totals(self) -> tuple[int, float]:
        """Documents and their mean length."""
        found = self._read("totals")
        docs, tokens = found.agg(F.sum("docs"), F.sum("tokens")).first() if found is not None else (0, 0)
        return docs or 0, (tokens or 0) / docs if docs else 0.0

    def _bounds(self, terms: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """(rows of the terms with idf and bound, postings included; the bound of every block), none without documents."""
        rows = self._read("postings")
        if rows is None or not terms:
            return None
        docs, mean = self.totals()
        rows = rows.filter(F.col("term").isin(sorted(set(terms))))
        counts = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row per term of the query
        weight = F.lit(0.0)
        for term, df in counts.items():
            weight = F.when(F.col("term") == term, F.lit(float(terms.count(term))) * F.ln(F.lit((docs - df + 0.5) / (df + 0.5) + 1))).otherwise(weight)
        rows = rows.withColumn("weight", weight).withColumn("bound", F.col("weight") * _gain(F.col("max_tf"), F.col("min_length"), mean))
        return rows, rows.groupBy("segment", "block").agg(F.sum("bound").alias("bound"), F.max("n").alias("docs"), F.sum("n").alias("postings"))

    def _scores(self, rows: DataFrame) -> DataFrame:
        _, mean = self.totals()
        each = rows.select("segment", "block", "weight", F.explode("docs").alias("d"))
        part = F.col("weight") * _gain(F.col("d.tf"), F.col("d.doc_length"), mean)
        return each.groupBy("segment", "block", F.col("d.key").alias("key")).agg(F.sum(part).alias("score")).select("key", "score")

    def _kept(self, terms: list[str], k: int | None, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        found = self._bounds(terms)
        if found is None:
            return None
        rows, bounds = found
        if not k:
            return rows, bounds, bounds
        # Of a block's documents at least `docs` hold one of the terms; k of them are enough for a threshold.
        best = bounds.orderBy(F.desc("bound"), "segment", "block").limit(max(first, 1)).select("segment", "block")
        scored = self._scores(rows.join(F.broadcast(best), ["segment", "block"])).orderBy(F.desc("score")).limit(k).select("score").collect()
        least = scored[-1]["score"] - SLACK if len(scored) == k else float("-inf")
        return rows, bounds, bounds.filter(F.col("bound") >= least)

    def search(self, terms: list[str], k: int | None = 20) -> DataFrame:
        """key, score of the best k documents, ties by key; all with k None. A term that the query repeats counts again."""
        found = self._kept(terms, k)
        if found is None:
            return self.spark.createDataFrame([], "key long, score double")
        rows, _, left = found
        scores = self._scores(rows.join(left.select("segment", "block"), ["segment", "block"]))
        return scores.orderBy(F.round("score", 9).desc(), F.asc("key")).limit(k) if k else scores

    def reading(self, terms: list[str], k: int) -> Reading:
        found = self._kept(terms, k)
        if found is None:
            return Reading(0, 0, 0, 0)
        summed = [df.agg(F.count("*"), F.coalesce(F.sum("postings"), F.lit(0))).first() for df in found[1:]]
        return Reading(summed[0][0], summed[1][0], summed[0][1], summed[1][1])


def index_of(docs: DataFrame, key: str, body: str, name: str) -> Bm25Index:
    """The index of a table read from files, made when its files are first seen in the shared folder; name: its columns."""
    spark = docs.sparkSession
    index = Bm25Index(spark, f"{shared.folder(spark)}/annalum/bm25-{name}-{shared.fingerprint(docs)}")
    if not index.totals()[0]:
        index.add(docs, key, F.col(body))
    return index

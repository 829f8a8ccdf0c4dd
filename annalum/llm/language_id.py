"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (1 to 3) of its lower-cased whole text, weighted by 1 + log(count) and
inverse document frequency, of length one. Each language has several centroids, clustered by spherical k-means; a text
gets the language of the centroid with the largest cosine. Its score is that cosine; where the distance to it is above
what `quantile` of the language's fitted texts have, times `slack`, the text is marked `rejected` (it keeps its nearest
language, as the only other answer, `und`, is for texts without a letter).

Document frequencies are counted over all training rows, summed per task and then by dimension. Centroids are fitted on
a bounded sample, language by language in tasks: PER_LANGUAGE distinct texts of each language, those of the smallest
hashes, about SAMPLE_ROWS in all and one at least; a cut by hash goes before the ranking, so no language is gathered in
one task. Fitted centroids are written. Predicting reads every row in Arrow batches and shuffles nothing; a model holds
MOST_CENTROIDS, and where there are more, the languages are cut into ranges, rows go through one range after the
other, and the best of all stays.

Defined results: null texts and texts without a letter are `und` with score 0; null languages are not learned from; a
table without training rows answers `und`; an empty table gives an empty result; rows repeated in full are predicted
alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.llm.common import frugal, held_out, read, small, written

DIMENSIONS, PER_LANGUAGE, SAMPLE_ROWS, MOST_CENTROIDS, CENTROIDS, ROUNDS, QUANTILE, SLACK = 4096, 600, 8000, 6000, 12, 12, 0.99, 1.1
_FACTORS = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2654435769))


def ngrams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the text's hashed n-grams."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(dimensions, np.float32)
    for factors in _FACTORS:
        n = len(b) - len(factors) + 1
        if n < 1:
            break
        h = np.zeros(n, np.uint32)
        for i, f in enumerate(factors):
            h += (b[i : i + n] + np.uint32(1)) * np.uint32(f)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        out += np.bincount(h >> np.uint32(8) & np.uint32(dimensions - 1), minlength=dimensions)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: tuple[str, ...]
    centroids: np.ndarray  # language by language
    owner: np.ndarray
    limit: np.ndarray  # by language

    def predict(self, texts: list[str]) -> tuple[list, list, list]:
        lang, score, rejected = [], [], []
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            if not self.languages:
                lang, score, rejected = lang + ["und"] * len(some), score + [0.0] * len(some), rejected + [True] * len(some)
                continue
            cosine = vectors(np.stack([ngrams(t, len(self.idf)) for t in some]), self.idf) @ self.centroids.T
            best = cosine.argmax(1)
            top = np.clip(cosine[np.arange(len(some)), best].astype(float), 0, 1)
            lang += [self.languages[i] for i in self.owner[best]]
            score += top.tolist()
            rejected += (1 - top > self.limit[self.owner[best]]).tolist()
        return lang, score, rejected


def cluster(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started from texts that are far apart."""
    centres = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        centres.append(v[(v @ np.stack(centres).T).max(1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(dimensions + 1, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            df[:-1] += ngrams(t, dimensions) > 0
            df[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1), pa.int32()), pa.array(df)], ["dim", "df"])


def _counted(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ngrams(t, dimensions).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["lang", "counts"])


def _fitted(batches: Iterator[pa.RecordBatch], idf: np.ndarray, centroids: int) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, counts) -> (lang, centroid, limit): the centroids of every language, in their order."""

    def of(lang: str, raw: list[bytes]) -> pa.RecordBatch:
        v = vectors(np.stack([np.frombuffer(b, np.float32) for b in raw]), idf)
        c = cluster(v, centroids).astype(np.float32)
        limit = float(np.quantile(1 - (v @ c.T).max(1), QUANTILE)) * SLACK
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(range(len(c)), pa.int32()), pa.array([x.tobytes() for x in c], pa.binary()), pa.array([limit] * len(c), pa.float64())], ["lang", "nth", "centroid", "limit"])

    now, raw = None, []
    for batch in batches:
        for lang, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang != now and raw:
                yield of(now, raw)
                raw = []
            now = lang
            raw.append(counts)
    if raw:
        yield of(now, raw)


@dataclass(frozen=True)
class Fitted:
    """What is learned: inverse document frequencies, and a written table of centroids with the ranges of languages."""

    idf: np.ndarray
    table: DataFrame | None
    ranges: tuple[tuple[str, str], ...]  # first and last language of each

    def models(self) -> Iterator[Model]:
        """One model a range, MOST_CENTROIDS centroids each; an empty one if nothing was learned."""
        if not self.ranges:
            yield Model(self.idf, (), np.zeros((0, len(self.idf)), np.float32), np.array([], int), np.array([]))
        for first, last in self.ranges:
            rows = self.table.filter(F.col("lang").between(first, last)).orderBy("lang", "nth").collect()
            languages = tuple(sorted({r.lang for r in rows}))
            at = {lang: i for i, lang in enumerate(languages)}
            limit = np.zeros(len(languages))
            for r in rows:
                limit[at[r.lang]] = r.limit
            yield Model(self.idf, languages, np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]), np.array([at[r.lang] for r in rows], int), limit)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS, most_centroids: int = MOST_CENTROIDS) -> Fitted:
    """From the texts and languages of rows that are not held out."""
    rows = docs.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sums = rows.select("text").mapInArrow(partial(_frequencies, dimensions=dimensions), "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(dimensions + 1)
    for r in sums:
        df[r["dim"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # About four times as many texts of a language as are wanted are ranked, whatever its size: those of small hashes.
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    kinds = written(hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "language-counts")
    known = kinds.count()
    per_language = min(per_language, max(1, SAMPLE_ROWS // max(known, 1)))
    share = F.least(F.lit(1.0), 4.0 * per_language / F.col("texts"))
    some = hashed.join(small(kinds), "lang").filter(F.pmod("h", F.lit(1 << 31)) < share * (1 << 31))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    picked = written(some.withColumn("r", rank).filter(F.col("r") <= per_language).select("lang", "text"), "language-sample")
    counted = picked.mapInArrow(partial(_counted, dimensions=dimensions), "lang string, counts binary")
    dealt = counted.repartition("lang").sortWithinPartitions("lang", "counts")  # whatever order they came in
    table = written(dealt.mapInArrow(frugal(partial(_fitted, idf=idf, centroids=centroids)), "lang string, nth int, centroid binary, limit double"), "language-centroids")
    each = max(1, most_centroids // centroids)  # languages a range
    languages = [r.lang for r in table.select("lang").distinct().orderBy("lang").collect()]
    return Fitted(idf, table, tuple((languages[i], languages[min(i + each, len(languages)) - 1]) for i in range(0, len(languages), each)))


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, last: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang_pred, score, rejected, lettered, text) with what this model says where that is better; the last
    model gives the first four alone."""
    for batch in batches:
        lang, score, rejected, lettered, texts = (batch.column(i).to_pylist() for i in range(1, 6))
        at = [i for i, x in enumerate(lettered) if x]
        for i, *got in zip(at, *model.predict([texts[i] for i in at]), strict=True):
            if lang[i] == "und" or got[1] > score[i]:
                lang[i], score[i], rejected[i] = got
        columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), batch.column(4), batch.column(5)]
        n = 4 if last else 6
        yield pa.RecordBatch.from_arrays(columns[:n], batch.schema.names[:n])


def identify(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row. Of equal cosines the language that sorts first stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), lettered, "text")
    schema, n = f"doc_id {kind}, lang_pred string, score double, rejected boolean", max(1, len(fitted.ranges))
    for i, model in enumerate(fitted.models()):
        # Between ranges rows are written: a task never holds two models.
        last = i == n - 1
        made = rows.mapInArrow(frugal(partial(_predicted, model=model, last=last)), schema if last else f"{schema}, lettered boolean, text string")
        rows = made if last else written(made, "language-so-far")
    return rows


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")

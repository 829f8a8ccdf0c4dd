"""A stored index of vectors: lists around centroids, probed by distance, with an exact way.

Vectors are brought to length one, so that cosine and distance say the same. Centroids are fitted by spherical k-means on
a bounded sample, the SAMPLE vectors of smallest hash; every vector then goes to the list of its nearest centroid,
whatever the sample was. A list of over LIST_ROWS vectors is cut by a hash into parts, and lists and parts are the order
of the files, so a search reads the parts it asks for. Of every list the index knows how far its members are from the
centroid.

Probing reads the `probe` lists of nearest centroid and ranks their members exactly; its recall is measured, not promised.
The exact way knows the largest cosine that a list's member can have (the triangle inequality over centroid and radius),
and reads every list whose bound reaches the least cosine asked for, or the k-th found. For many queries at once, lists
stand in blocks of about BLOCK vectors, queries in blocks of BLOCK; a query goes to the blocks with a list that it must
look at, and of each pair of blocks the product is taken (vector_pairs). Tasks hold AT_ONCE distances to centroids at most.

Null vectors, those of another length than most, with a part that is not finite, and zero vectors are not indexed. Keys are
unique. The centroids are what the driver holds: at most MOST_LISTS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.operators import vector_pairs
from annalum.operators.vector_pairs import BLOCK
from annalum.operators.windows import top_n
from annalum.sources import shared
from annalum.sources.sinks import finished

SAMPLE, MOST_LISTS, LIST_ROWS, ROUNDS, SLACK = 20_000, 4096, 4096, 12, 1e-6
AT_ONCE = 1 << 21


def _units(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, vector) -> (key, v) of length one, of the vectors that have one."""
    for batch in batches:
        own = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False))
        v = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # a null part is NaN
        length = np.sqrt((v * v).sum(1, keepdims=True))
        fine = np.isfinite(length[:, 0]) & (length[:, 0] > 0)
        v = (v[fine] / length[fine]).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, size, dtype=np.int32)), pa.array(v))
        yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(fine)), lists], batch.schema.names)


def units(vectors: DataFrame, key: str, vector: str, size: int, name: str = "id") -> DataFrame:
    """name, v: vectors of length one; without those that cannot be."""
    rows = vectors.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(partial(_units, size=size), f"{name} {rows.schema[name].dataType.simpleString()}, v array<double>")


def fit(v: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over the rows of v, started from evenly spread rows."""
    c = v[np.linspace(0, len(v) - 1, min(lists, len(v))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(part @ c.T).argmax(1) for part in _pieces(v, len(c))])
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def _pieces(rows, lists: int) -> Iterator:
    """Rows of an array or a batch, a few at a time."""
    step = max(1, AT_ONCE // max(lists, 1))
    for at in range(0, len(rows), step):
        yield rows[at : at + step] if isinstance(rows, np.ndarray) else rows.slice(at, step)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _listed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, v) -> (key, v, list, away)."""
    for whole in batches:
        for batch in _pieces(whole, len(centroids)):
            v = _matrix(batch.column(1), centroids.shape[1])
            near = v @ centroids.T
            own = near.argmax(1)
            away = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(v)), own]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], ["key", "v", "list", "away"])


def _probes(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, probe: int | None, least: float) -> Iterator[pa.RecordBatch]:
    """(id, q) -> (id, q, list, place) for the lists that a query looks at; place: the list's among those nearest to it."""
    for whole in batches:
        for batch in _pieces(whole, len(centroids) * centroids.shape[1]):  # a query's vector goes out once a list
            q = _matrix(batch.column(1), centroids.shape[1])
            place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
            row, lists = np.nonzero(place < probe if probe else bounds(q, centroids, radius) >= least - SLACK)
            columns = [*(c.take(pa.array(row)) for c in batch.columns), pa.array(lists.astype(np.int32)), pa.array(place[row, lists].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "q", "list", "place"])


def _reached(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, block: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(id, v, i) -> (id, v, i, j) for the blocks with a list that a query must look at; block: first and last of a list."""
    covers = (block[:, :1] <= np.arange(block.max() + 1)) & (np.arange(block.max() + 1) <= block[:, 1:])
    for whole in batches:
        for batch in _pieces(whole, len(centroids) + covers.shape[1] * centroids.shape[1]):
            reach = bounds(_matrix(batch.column(1), centroids.shape[1]), centroids, radius) >= least - SLACK
            row, j = np.nonzero(reach.astype(np.float32) @ covers.astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(j.astype(np.int32))], ["id", "v", "i", "j"])


def bounds(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosine that a member of each list can have to each row of q."""
    away = np.sqrt(np.maximum(0, 2 - 2 * (q @ centroids.T)))
    return 1 - np.maximum(0, away - radius) ** 2 / 2


@dataclass(frozen=True)
class VectorIndex:
    """The index in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    size: int
    centroids: np.ndarray = field(repr=False)
    radius: np.ndarray = field(repr=False)  # by list; under 0: the list is empty
    parts: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str, size: int, path: str, lists: int | None = None, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> VectorIndex:
        spark = vectors.sparkSession
        own = shared.kept(units(vectors, key, vector, size, "key"), "unit-vectors")
        n = own.count()
        lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
        some = own.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()  # `sample` rows at most
        centroids = fit(np.array([r.v for r in some], float), lists) if some else np.zeros((1, size))
        kind = own.schema["key"].dataType.simpleString()
        listed = shared.kept(own.mapInArrow(partial(_listed, centroids=centroids), f"key {kind}, v array<double>, list int, away double"), "listed-vectors")
        heads = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
        radius, parts = np.full(len(centroids), -1.0), np.ones(len(centroids), int)
        for r in heads:
            radius[r["list"]], parts[r["list"]] = r["radius"], -(-r["n"] // list_rows)
        cut = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
        dealt = listed.drop("away").withColumn("part", F.pmod(F.xxhash64("key"), cut).cast("int"))
        dealt.repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").parquet(f"{path}/lists")
        rows = [(i, float(radius[i]), int(parts[i]), c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "list int, radius double, parts int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")
        return cls(spark, path, size, centroids, radius, parts)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        if not finished(spark, f"{path}/heads"):
            return None
        rows = spark.read.parquet(f"{path}/heads").orderBy("list").collect()
        centroids = np.array([r.centroid for r in rows])
        return cls(spark, path, centroids.shape[1], centroids, np.array([r.radius for r in rows]), np.array([r.parts for r in rows]))

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def _near(self, q: np.ndarray, lists: list[int]) -> DataFrame:
        """key, similarity of the members of some lists."""
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return self._lists().filter(F.col("list").isin(lists)).select("key", dot.alias("similarity"))

    def topk(self, query: list[float], k: int, least: float = -1.0, probe: int | None = None) -> DataFrame:
        """key, similarity of the k nearest of at least `least`, ties by key; probe None: exact."""
        q = np.array(query, float) / max(np.linalg.norm(query), 1e-300)
        order = np.argsort(-(bound := bounds(q[None], self.centroids, self.radius)[0]), kind="stable")
        order = [int(i) for i in order if self.radius[i] >= 0 and bound[i] >= least - SLACK]
        ranked = lambda lists: self._near(q, lists).filter(F.col("similarity") >= least).orderBy(F.round("similarity", 9).desc(), F.asc("key")).limit(k)
        if probe:
            return ranked(sorted(order, key=lambda i: -float(q @ self.centroids[i]))[:probe])
        first = [r.similarity for r in ranked(order[:8]).collect()] if len(order) > 8 else []  # k rows
        floor = min(first) - SLACK if len(first) == k else least - SLACK
        return ranked([i for i in order if bound[i] >= floor])

    def candidates(self, queries: DataFrame, key: str, vector: str, k: int, least: float, probe: int | None = None) -> DataFrame:
        """id, candidate_id, similarity, rank: of every query the k nearest others of at least `least`; probe None: exact.

        With `probe`, a query goes to the lists that it looks at, and there to every part; a list is met in parts, never
        as a whole."""
        return self._ranked(queries, key, vector, k, least, probe).drop("place") if probe else self._exact(queries, key, vector, k, least)

    def _exact(self, queries: DataFrame, key: str, vector: str, k: int, least: float, block: int = BLOCK) -> DataFrame:
        asked = shared.kept(units(queries, key, vector, self.size), "asked-vectors")
        many, rows = max(1, -(-asked.count() // block)), self._lists().count()
        first = np.cumsum(self.parts) - self.parts
        wide = max(1, block * int(self.parts.sum()) // max(rows, 1))  # parts a block
        of_list = np.stack([first // wide, (first + self.parts - 1) // wide], 1)
        kind = asked.schema["id"].dataType.simpleString()
        left = asked.withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(many)).cast("int"))
        left = left.mapInArrow(partial(_reached, centroids=self.centroids, radius=self.radius, block=of_list, least=least), f"id {kind}, v array<double>, i int, j int")
        at = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col("list") + 1) + F.col("part")
        right = self._lists().select(F.col("key").alias("id"), "v", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("i"), F.floor(at / wide).cast("int").alias("j"))
        side = lambda df, n: df.select(F.lit(0).alias("g"), F.lit(self.size).alias("size"), "i", "j", F.lit(n).alias("side"), "id", "v")
        return vector_pairs.nearest_in_cells(side(left, 0).unionByName(side(right, 1)), many * (int(of_list.max()) + 1), k, least)

    def _ranked(self, queries: DataFrame, key: str, vector: str, k: int, least: float, probe: int | None) -> DataFrame:
        kind = queries.schema[key].dataType.simpleString()
        asked = units(queries, key, vector, self.size).withColumnRenamed("v", "q")
        asked = asked.mapInArrow(partial(_probes, centroids=self.centroids, radius=self.radius, probe=probe, least=least), f"id {kind}, q array<double>, list int, place int")
        parts = F.element_at(F.array(*[F.lit(int(p)) for p in self.parts]), F.col("list") + 1)
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        met = asked.join(self._lists(), ["list", "part"]).filter("id <> key").select("id", F.col("key").alias("candidate_id"), dot.alias("similarity"), "place")
        return top_n(met.filter(F.col("similarity") >= least), ["id"], [F.round("similarity", 9).desc(), F.asc("candidate_id")], k)

    def probe_for(self, queries: DataFrame, key: str, vector: str, k: int, least: float, recall: float = 0.95) -> int:
        """How many lists to probe so that of these queries' exact answers a share of `recall` is found: each answer's list
        has a place among those nearest to its query, and that is the quantile of the places. Give a bounded sample."""
        found = self._ranked(queries, key, vector, k, least, None).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
        total, seen = sum(r.n for r in found), 0
        for r in found:
            seen += r.n
            if seen >= recall * total:
                return r.place + 1
        return len(self.centroids)


def index_of(vectors: DataFrame, key: str, vector: str, size: int, name: str) -> VectorIndex:
    """The index of a table read from files, made when its files are first seen in the shared folder."""
    spark = vectors.sparkSession
    path = f"{shared.folder(spark)}/annalum/vectors-{name}-{shared.fingerprint(vectors)}"
    return VectorIndex.open(spark, path) or VectorIndex.build(vectors, key, vector, size, path)

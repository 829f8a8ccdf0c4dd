"""Centroid clustering by ball k-means, in exact integers.

A cluster is a ball: its centroid and a bound of the distance from there to its members. In a round, the neighbours of
a ball are the centroids that are less than twice its radius away, nearest first; no member can be nearer to another one.
A member at distance d from its own centroid is nearer to it than to any centroid over 2d away. So the half distances
to the neighbours cut a ball into a stable core, where nothing is compared, and annuli, where a member is compared with
the neighbours up to its annulus and no others. Distances are squared integers, and a tie at a border is compared, so
the assignment is that of full comparison, ties included.

A round is one map over the vectors: it gives, per task and ball, the count, the sum and the farthest member, which
Spark adds up; the driver gets count, radius and sum of every ball. The bound of a moved ball is its farthest member's
distance plus the centroid's shift. Assignments are not written in every round: a task walks its vectors through the
balls since the last written ones, KEEP rounds at most, which costs less than writing vectors; then vectors are
written anew with their ball, and the table before is deleted. A lost task walks again.

Components are floor(scale * x); they are held within the range where 4 times a squared distance is a 64-bit number,
for 64 components 2^26, and larger ones take its border.

Defined results: vectors that are null, of another length, or hold a null or a non-finite component are left out;
first centroids are those with the least hash of their id, ties by components, a null id hashed as empty text; with
fewer vectors than k there are as many centroids as vectors; equal centroids leave all to the smaller number; rows
repeated in full are vectors of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, read, rewritten, written

K, ROUNDS, SIZE, SCALE, SALT, KEEP = 8, 10, 64, 1024, "3:", 4
MOST = 2**63 - 1


@dataclass(frozen=True)
class Balls:
    """Centroids by number, and of every ball its neighbours, nearest first, with their squared distances.
    Without radii nothing is known about members: they are compared with all centroids."""

    centroids: np.ndarray
    near: tuple[np.ndarray, ...] | None = None
    gaps: tuple[np.ndarray, ...] | None = None

    @classmethod
    def around(cls, centroids: np.ndarray, radius: list[int]) -> Balls:
        near, gaps = [], []
        for i, r in enumerate(radius):
            apart = squared(centroids, centroids[i])
            order = np.argsort(apart, kind="stable")
            order = order[(order != i) & (apart[order] <= min(4 * r * r, MOST))]
            near.append(order)
            gaps.append(apart[order])
        return cls(centroids, tuple(near), tuple(gaps))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


def assign(v: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector, its squared distance, and how many distances were computed."""
    centroids = balls.centroids
    if balls.near is None:
        own, d = np.zeros(len(v), np.int32), squared(v, centroids[0])
        for j in range(1, len(centroids)):
            dj = squared(v, centroids[j])
            nearer = dj < d
            own[nearer], d[nearer] = j, dj[nearer]
        return own, d, len(v) * len(centroids)
    d = squared(v, centroids[own])
    found, compared = own.copy(), len(v)
    for i, (near, gaps) in enumerate(zip(balls.near, balls.gaps, strict=True)):
        if not len(near):
            continue
        members = np.flatnonzero(own == i)
        annulus = np.searchsorted(gaps, 4 * d[members], "right")
        members, annulus = members[annulus > 0], annulus[annulus > 0]
        for at, j in enumerate(near):
            members, annulus = members[annulus > at], annulus[annulus > at]
            if not len(members):
                break
            dj = squared(v[members], centroids[j])
            compared += len(members)
            nearer = (dj < d[members]) | ((dj == d[members]) & (j < found[members]))
            found[members[nearer]], d[members[nearer]] = j, dj[nearer]
    return found, d, compared


def _walked(batch: pa.RecordBatch, steps: list[Balls]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vec_id, v, ball): vectors, their ball after the steps, the squared distance, distances computed in the last step."""
    size = steps[0].centroids.shape[1]
    v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)
    own = batch.column(2).to_numpy(zero_copy_only=False)
    for balls in steps:
        own, d, compared = assign(v, own, balls)
    return v, own, d, compared


def _summed(batches: Iterator[pa.RecordBatch], steps: list[Balls]) -> Iterator[pa.RecordBatch]:
    """-> (ball, n, farthest, compared, sums) of the task's members."""
    k, size = steps[0].centroids.shape
    n, far, sums, compared = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, size), np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        v, own, d, more = _walked(batch, steps)
        compared += more
        n += np.bincount(own, minlength=k)
        for i in np.unique(own):
            members = own == i
            sums[i] += v[members].sum(0)
            far[i] = max(far[i], int(d[members].max()))
    held = np.flatnonzero(n)
    if len(held):
        shares = np.where(np.arange(len(held)) == 0, compared, 0)
        columns = [pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(far[held]), pa.array(shares), pa.array(sums[held].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["ball", "n", "farthest", "compared", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], steps: list[Balls], with_vectors: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, own, d, _ = _walked(batch, steps)
        last = (batch.column(0), batch.column(1), pa.array(own, pa.int32())) if with_vectors else (batch.column(0), pa.array(own, pa.int32()), pa.array(d, pa.int64()))
        yield pa.RecordBatch.from_arrays(list(last), ["vec_id", "v", "ball"] if with_vectors else ["vec_id", "cluster", "distance"])


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>) of the vectors that are kept."""
    most = 1 << (59 - math.ceil(math.log2(size))) // 2
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return vectors.filter((F.size("embedding") == size) & ~bad).select("vec_id", whole.alias("v"))


def _root(x: int) -> int:
    """The least integer whose square is at least x."""
    return math.isqrt(x - 1) + 1 if x > 0 else 0


def _moved(table: DataFrame, steps: list[Balls]) -> tuple[Balls, int]:
    """The balls after a round over table (vec_id, v, ball), and the distances that it computed."""
    last = steps[-1].centroids
    parts = table.mapInArrow(frugal(partial(_summed, steps=steps)), "ball int, n long, farthest long, compared long, sums array<long>")
    exact = F.sum(F.col("s").cast("decimal(38,0)"))
    rows = parts.select("ball", "n", "farthest", "compared", F.posexplode("sums").alias("at", "s")).groupBy("ball", "at").agg(exact.alias("s"), F.sum("n").alias("n"), F.max("farthest").alias("far"), F.sum("compared").alias("compared")).collect()
    centroids, far = last.copy(), [0] * len(last)
    for r in rows:
        centroids[r.ball, r.at] = int(r.s) // r.n
        far[r.ball] = r.far
    radius = [_root(far[i]) + _root(int(shift)) for i, shift in enumerate(squared(centroids, last))]
    return Balls.around(centroids, radius), sum(r.compared for r in rows if r["at"] == 0)


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT, keep: int = KEEP) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, cluster, distance of every kept vector (a written table), the centroids by number, and the distances
    that each round computed."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    table = written(quantised(vectors, size, scale).withColumn("ball", F.lit(0)), "ball-vectors")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = table.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64), []
    steps, compared = [Balls(np.array([r.v for r in first], np.int64))], []
    for done in range(rounds):
        if len(steps) > keep:
            schema = f"vec_id {kind}, v array<int>, ball int"
            table = rewritten(table, table.mapInArrow(frugal(partial(_assigned, steps=steps[:-1], with_vectors=True)), schema), "ball-vectors")
            steps = steps[-1:]
        balls, n = _moved(table, steps)
        steps.append(balls)
        compared.append(n)
    last = table.mapInArrow(frugal(partial(_assigned, steps=steps, with_vectors=False)), f"vec_id {kind}, cluster int, distance long")
    return rewritten(table, last, "ball-clusters"), steps[-1].centroids, compared


def summary(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, cluster_inertia, inertia, centroid_sha256: a row per centroid."""
    total = clusters.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.cluster: int(r.s) for r in total}
    rows = [(i, min(sums.get(i, 0), MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    return clusters.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    clusters, centroids, _ = ball_kmeans(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clusters.join(F.broadcast(summary(clusters, centroids)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Plain k-means: every vector against every centroid; a pair's key is distance * K + number, the least one wins."""
    near = "SELECT i, min(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {K} + c) AS m FROM kept k, c{n} c GROUP BY i"
    steps = []
    for n in range(ROUNDS):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(K=K, n=n)})")
        steps.append(f"""s{n} AS (SELECT CAST(m % {K} AS BIGINT) AS c, j, CAST(sum(v[j]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n
          FROM a{n} JOIN kept USING (i), range(1, {SIZE + 1}) t(j) GROUP BY ALL)""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(f.v, o.v) AS v FROM c{n} o
          LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{n} GROUP BY c) f USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
  (SELECT sha256('{SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {K})),
{', '.join(steps)},
last AS MATERIALIZED ({near.format(K=K, n=ROUNDS)}),
f AS (SELECT vec_id, CAST(m % {K} AS INT) AS cluster, CAST(m // {K} AS BIGINT) AS distance FROM last JOIN kept USING (i))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c ON c.c = cluster
"""


SQL = _sql()

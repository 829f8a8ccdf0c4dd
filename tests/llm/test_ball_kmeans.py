"""Ball k-means against plain k-means with Python's integers."""

import hashlib
import math

import numpy as np

from annalum.llm import ball_kmeans as bk
from tests.conftest import rows_of


def plain(rows, k=8, rounds=10, size=64, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def check(vectors, **how):
    clusters, centroids, compared = bk.ball_kmeans(vectors, **how)
    got = sorted([tuple(r) for r in clusters.select("vec_id", "cluster", "distance").collect()], key=repr)
    rows, means = plain([(r.vec_id, r.embedding) for r in vectors.collect()], **{x: y for x, y in how.items() if x != "keep"})
    assert got == sorted(rows, key=repr) and centroids.tolist() == means
    return compared, len(got)


def test_embeddings(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    for keep in (1, 4, 20):
        compared, n = check(vectors, keep=keep)
        assert compared[0] == 8 * n and max(compared[1:]) <= 8 * n


def test_balls_leave_out_what_cannot_be_nearer(spark):
    """Three far groups, of which each is near to itself only: after the first round one distance a vector is enough."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + [40.0 * (i % 3), 0, 0, 0]).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compared, n = check(vectors, k=3, size=4, rounds=6)
    assert n == 300 and compared[-1] < 2 * n


def test_ties_go_to_the_smaller_number():
    """On a lattice many vectors lie on borders; assignment from any earlier one equals full comparison."""
    grid = np.array([(x, y) for x in range(-6, 7) for y in range(-6, 7)], np.int64)
    centroids = np.array([(2, 0), (-2, 0), (0, 2), (0, -2), (0, 2), (5, 5)], np.int64)
    best, d, _ = bk.assign(grid, np.zeros(len(grid), np.int32), bk.Balls(centroids))
    for before in (np.array([(1, 0), (-1, 1), (0, 3), (0, -2), (0, 2), (9, 9)], np.int64), centroids):
        own, _, _ = bk.assign(grid, np.zeros(len(grid), np.int32), bk.Balls(before))
        radius = [bk._root(int(bk.squared(grid[own == j], centroids[j]).max(initial=0))) for j in range(len(centroids))]
        again, d2, compared = bk.assign(grid, own, bk.Balls.around(centroids, radius))
        assert (again == best).all() and (d2 == d).all() and compared <= len(grid) * len(centroids)


def test_awkward_vectors(spark):
    one = [float(i) / 7 for i in range(64)]
    rows = [(1, one, 1, "x"), (1, one, 1, "x"), (2, None, 1, "x"), (3, [], 1, "x"), (4, one[:63], 1, "x"), (5, [None, *one[1:]], 1, "x"), (6, [float("nan"), *one[1:]], 1, "x"),
            (7, [float("-inf"), *one[1:]], 1, "x"), (None, [-x for x in one], 2, "y"), (8, [x - 9 for x in one], None, None), (9, [-0.0] * 64, 1, "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, v string")
    _, n = check(vectors)
    assert n == 5
    clusters, centroids, _ = bk.ball_kmeans(vectors.limit(0))
    assert clusters.count() == 0 and len(centroids) == 0
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i] * 64) for i in range(12)], "vec_id long, embedding array<double>")
    clusters, centroids, _ = bk.ball_kmeans(huge)
    assert sorted({r.distance for r in clusters.collect()}) == [0] and np.abs(centroids).max() == 1 << 26


def test_written_tables_are_replaced(spark, data):
    from annalum.llm import common

    held = len(common._PATHS)
    clusters, *_ = bk.ball_kmeans(spark.read.parquet(f"{data}/embeddings.parquet"), rounds=9, keep=2)
    assert len(common._PATHS) == held + 1 and len(rows_of(clusters)) == 500

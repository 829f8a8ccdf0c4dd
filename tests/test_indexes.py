"""Stored indexes against plain search."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annalum.operators import bm25_index, search
from annalum.operators.bm25_index import Bm25Index
from annalum.operators.vector_index import VectorIndex
from annalum.sources import shared


def zipfian(rng, n, words=300):
    return [(i, " ".join(chr(97 + w % 26) * (1 + w // 26) for w in (int(words ** rng.random()) for _ in range(rng.randrange(1, 60))))) for i in range(n)]


def plain(docs, terms, k):
    tokens = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    scores = {}
    for term in terms:
        df = sum(term in w for w in tokens.values())
        for i, w in tokens.items():
            tf = Counter(w)[term]
            if tf:
                scores[i] = scores.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((round(s, 6), -i) for i, s in scores.items()), reverse=True)[:k]


def new(spark):
    return Bm25Index(spark, shared.new_path(spark, "bm25"))


def test_search_equals_a_scan(spark):
    rng = random.Random(1)
    docs = zipfian(rng, 900)
    df = spark.createDataFrame(docs, "id long, body string").repartition(4)
    index = new(spark)
    assert index.search(["a"], 5).count() == 0 and index.totals() == (0, 0.0)
    assert index.add(df, "id", F.col("body"), 16) == 900
    for terms in (["a"], ["a", "bb", "a"], ["ccccc", "zzzzzz", "b"], ["nothing"], []):
        for k in (1, 7, 2000):
            got = [(round(r.score, 6), -r.key) for r in index.search(terms, k).collect()]
            assert sorted(got, reverse=True) == plain(docs, terms, k)
            assert sorted(got) == sorted((round(r.score, 6), -r.id) for r in search.bm25(df, "id", F.col("body"), terms, k).collect())
    assert index.search(["a"], None).count() == sum("a" in t.split() for _, t in docs)


def test_blocks_below_the_threshold_are_not_read(spark):
    """A rare term decides: blocks with the common one alone cannot reach the best."""
    rng = random.Random(2)
    docs = [(i, "rare rare rare" if i % 500 == 3 else " ".join(rng.choice(["common", "x", "y"]) for _ in range(rng.randrange(5, 60)))) for i in range(3000)]
    index = new(spark)
    index.add(spark.createDataFrame(docs, "id long, body string"), "id", F.col("body"), 16)
    read = index.reading(["rare", "common"], 5)
    assert read.blocks > 150 and read.postings > 2000
    assert read.blocks_kept <= 12 and read.postings_kept < read.postings / 10
    got = [(round(r.score, 6), -r.key) for r in index.search(["rare", "common"], 5).collect()]
    assert sorted(got, reverse=True) == plain(docs, ["rare", "common"], 5)


def test_documents_are_added(spark):
    """Two batches give what one gives; a batch again, and one that broke off, change nothing."""
    rng = random.Random(3)
    docs = zipfian(rng, 400) + [(400, None), (401, "")]
    df = spark.createDataFrame(docs, "id long, body string")
    index = new(spark)
    assert index.add(df.filter("id < 150"), "id", F.col("body"), 32) == 150
    assert index.add(df.filter("id >= 100"), "id", F.col("body"), 32) == 252
    assert index.add(df, "id", F.col("body"), 32) == 0
    df.limit(1).write.parquet(f"{index.path}/000009-broken/postings")
    assert index.totals()[0] == 402
    got = [(round(r.score, 6), -r.key) for r in index.search(["a", "bb"], 30).collect()]
    assert sorted(got, reverse=True) == plain(docs, ["a", "bb"], 30)
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(900, "a"), (900, "b")], "id long, body string"), "id", F.col("body"))
    assert index.add(spark.createDataFrame([(None, "a")], "id long, body string"), "id", F.col("body")) == 0


def test_the_index_of_a_table_is_made_once(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    first = bm25_index.index_of(docs, "doc_id", "text", "twice")
    monkeypatch.setattr(Bm25Index, "add", lambda *a: pytest.fail("made again"))
    assert bm25_index.index_of(docs, "doc_id", "text", "twice") == first


def test_tokens_are_those_of_the_columns(spark):
    from annalum.functions import text

    texts = ["The War, of 1812!", "", "\uac00\ub098\ub2e4 abc \uac00", "\u3042\u3044 \u4e2d x\u4e2d\u6587y", "A\u00e9b \u0130I", "no-one's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(F.lower("t").alias("low"), text.tokens(F.col("t")).alias("want")).collect():
        assert bm25_index.tokens(r.low) == r.want


# ---- vectors

def clustered(rng, n, size=16, groups=12):
    centres = rng.normal(size=(groups, size))
    return [(i, (centres[rng.integers(groups)] + 0.5 * rng.normal(size=size)).tolist()) for i in range(n)]


def nearest(rows, q, k, least, own=None):
    import numpy as np

    keys = np.array([i for i, _ in rows if i != own])
    v = np.array([x for i, x in rows if i != own])
    s = v @ np.array(q) / np.linalg.norm(v, axis=1) / np.linalg.norm(q)
    order = [i for i in np.lexsort((keys, -np.round(s, 9))) if s[i] >= least][:k]
    return [(int(keys[i]), round(float(s[i]), 6)) for i in order]


@pytest.fixture(scope="module")
def vectors(spark):
    import numpy as np

    rows = clustered(np.random.default_rng(4), 1500)
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "id", "v", 16, shared.new_path(spark, "vectors"), list_rows=40)
    return rows, index


def test_exact_search(spark, vectors):
    rows, index = vectors
    assert index.parts.max() > 1 and len(index.centroids) == 38
    again = VectorIndex.open(spark, index.path)
    assert (again.centroids == index.centroids).all() and (again.parts == index.parts).all()
    for q in (rows[3][1], [1.0] * 16, [-x for x in rows[9][1]]):
        for k, least in ((10, -1.0), (5, 0.6), (3000, 0.2)):
            assert [(r.key, round(r.similarity, 6)) for r in again.topk(q, k, least).collect()] == nearest(rows, q, k, least)


def test_candidates_of_rows_and_recall(spark, vectors):
    rows, index = vectors
    asked = spark.createDataFrame([r for r in rows if r[0] % 20 == 0], "id long, v array<double>")
    exact = index.candidates(asked, "id", "v", 10, 0.5)
    by = {}
    for r in exact.orderBy("id", "rank").collect():
        by.setdefault(r.id, []).append((r.candidate_id, round(r.similarity, 6)))
    want = {i: nearest(rows, v, 10, 0.5, i) for i, v in rows if i % 20 == 0}
    assert by == {i: x for i, x in want.items() if x}
    probed = index.candidates(asked, "id", "v", 10, 0.5, probe=8).collect()
    hits = sum((r.candidate_id, round(r.similarity, 6)) in want[r.id] for r in probed)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [-2.0, 0.0]), (9, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(df, "id", "v", 2, shared.new_path(spark, "vectors"))
    assert [tuple(r) for r in index.topk([2.0, 0.0], 5).collect()] == [(1, 1.0), (9, 1.0), (8, -1.0)]
    assert [(r.id, r.candidate_id) for r in index.candidates(df, "id", "v", 1, 0.0).orderBy("id").collect()] == [(1, 9), (9, 1)]
    empty = VectorIndex.build(df.limit(0), "id", "v", 2, shared.new_path(spark, "vectors"))
    assert empty.topk([1.0, 0.0], 3).count() == 0 and empty.candidates(df, "id", "v", 1, 0.0).count() == 0


def test_recall_on_the_embeddings(spark, data):
    """These vectors hardly cluster: the number of lists to probe comes from other queries' exact answers."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    index = VectorIndex.build(df, "vec_id", "embedding", 64, shared.new_path(spark, "vectors"))
    probe = index.probe_for(df.filter("vec_id % 20 in (5, 10, 15)"), "vec_id", "embedding", 5, 0.2)
    assert 1 < probe < len(index.centroids)
    asked = df.filter("vec_id % 20 = 0")
    exact = {(r.id, r.candidate_id) for r in index.candidates(asked, "vec_id", "embedding", 5, 0.2).collect()}
    probed = {(r.id, r.candidate_id) for r in index.candidates(asked, "vec_id", "embedding", 5, 0.2, probe=probe).collect()}
    assert len(exact) > 50 and len(exact & probed) >= 0.9 * len(exact)

"""Queries against their SQL or plain loops on rows that the smallest tables do not have."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__  # noqa: F401
from annalum.functions import strings
from annalum.operators import graph, joins, pairs, resolve, similar_strings, vector_index, vector_pairs
from annalum.plans import complete, knowledge, whole
from annalum.plans.catalog import ORACLE_SQL, QUERIES
from annalum.schema import Tables
from annalum.sources import shared
from tests.conftest import rows_of, rows_of_sql


@pytest.fixture
def against_sql(spark, data, tmp_path):
    """Rows of a query over the given tables (name: rows, schema), and the driver's others; equal to those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table in ("nation", "region", "part", "supplier", "customer", "orders", "lineitem", "embeddings"):
            rows, schema = tables.get(table, (None, None))
            made = spark.read.parquet(f"{data}/{table}.parquet") if rows is None else spark.createDataFrame(rows, schema)
            made.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        names, want = rows_of_sql(con, ORACLE_SQL[name])
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(got.columns) == names and rows_of(got) == want
        return want

    return run


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_decades_around_zero(against_sql):
    """-9 to 9 are one decade in the SQL; places of one nation are the same place."""
    keys = [k for k in range(200_000) if -31 < k * 7919 % 5001 - 3000 < 31 and k % 25 in (3, 7)]
    assert against_sql("box_and_title_match", part=([(k, ("red ring", "red rod")[k % 2], "b", "t", 1) for k in keys], PART))


def test_registry_links_compare_no_names(spark, monkeypatch):
    """Links by name and alias are those of the decisions over all candidates, and are found without candidates."""
    rng = random.Random(3)
    names = [(i, rng.choice([None, " ", "Ring of x", "ring of X ", "Rod II", "Rod", f"rod {i % 9}"])) for i in range(80)]
    entities = spark.createDataFrame(names, "id long, name string")
    aliases = spark.createDataFrame([(5, "rod 3"), (2, " ROD 3"), (70, "rod"), (4, None)], "entity_id long, alias string")
    for known in (aliases, None):
        every = resolve.registry_decisions(entities, aliases=known).filter("reason in ('exact', 'alias')").select("id", "match_id", "score", "reason")
        assert rows_of(resolve.registry_links(entities, known)) == rows_of(every) and every.count() > 50
    monkeypatch.setattr(resolve, "blocked_pairs", None)
    assert whole.registry_alias_decisions(Tables(spark, "/root/testdata/sf0.001")).count() > 0


# ---- cosines of pairs

def crowded(n, seed, groups=3):
    """Vectors of groups, with copies, opposite ones, and some without a cosine."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=6).round(2).tolist(), int(rng.integers(groups))) for i in rng.permutation(n)]
    rows += [(n + i, [3 * x for x in rows[i][1]], rows[i][2]) for i in range(n // 5)]
    return [*rows, (9001, None, 1), (9002, [], 1), (9003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (9004, [1.0] * 5, 1), (9005, [1.0] * 5, 1), (9006, [1.0] * 6, None)]


def cosine(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def plain(rows):
    return [r for r in rows if r[1] and None not in r[1] and r[2] is not None]


@pytest.mark.parametrize("block", [25, 10_000])
def test_pairs_of_vectors_in_cells(spark, block):
    rows = crowded(120, 1)
    got = vector_pairs.within(spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3), "id", "label", "v", 0.5, block).collect()
    want = {(x[2], x[0], y[0], round(s, 9)) for x in plain(rows) for y in plain(rows) if x[2] == y[2] and x[0] < y[0] and len(x[1]) == len(y[1]) and (s := cosine(x[1], y[1])) >= 0.5}
    assert {(r.label, r.a_id, r.b_id, round(r.similarity, 9)) for r in got} == want and len(got) == len(want) > 300


@pytest.mark.parametrize("block", [25, 10_000])
def test_nearest_vectors_in_cells(spark, block):
    rows = crowded(120, 2)
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    for some in (rows, [r for r in rows if r[0] % 2 == 0]):
        others = df if some is rows else df.filter("id % 2 = 0")
        got = vector_pairs.nearest(df, others, "id", "v", 4, 0.2, "label", block=block).collect()
        want = set()
        for x in plain(rows):
            near = sorted((-round(s, 9), y[0]) for y in plain(some) if x[2] == y[2] and x[0] != y[0] and len(x[1]) == len(y[1]) and (s := cosine(x[1], y[1])) >= 0.2)
            want |= {(x[0], j, n + 1) for n, (_, j) in enumerate(near[:4])}
        assert {(r.id, r.candidate_id, r["rank"]) for r in got} == want and len(got) == len(want) > 200


def test_pairs_of_vectors_are_products(spark, data):
    """Pairs of a crowded label are no rows of a plan: a vector leaves once a cell, and no interpreted sum is left."""
    t = Tables(spark, data)
    for df in (knowledge.near_duplicate_vectors(t), complete.vector_candidates(t), complete.five_stage_match(t), knowledge.vector_neighbours(t), whole.retrieved_contexts(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in plan and "MapInArrow" in plan


def test_sure_by_the_raw_similarity(spark):
    near = spark.createDataFrame([(1, 2, 0.3, 0.2999999, True)], "id long, match_id long, similarity double, raw double, verified boolean")
    none = lambda schema: spark.createDataFrame([], schema)
    got = resolve.five_stage_match(spark.createDataFrame([(1, "x", None)], "id long, name string, key long"), none("id long, name string"), none("entity_id long, alias string"), none("entity_id long, key long"), near, 0.3, 0.2)
    assert [tuple(r) for r in got.collect()] == [(1, 2, "verified", 0.3)]


def test_exact_candidates_by_blocks(spark):
    """Many queries against many lists: whatever the blocks are, and with pieces of one query, the answers are those of all pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 3 * np.eye(8)[i % 8]).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.VectorIndex.build(df, "id", "v", 8, shared.new_path(spark, "vectors"), list_rows=16)
    want = {(r.id, r.candidate_id, r["rank"]) for r in vector_pairs.nearest(df, df, "id", "v", 3, 0.6).collect()}
    for block in (30, 100_000):
        assert {(r.id, r.candidate_id, r["rank"]) for r in index._exact(df, "id", "v", 3, 0.6, block).collect()} == want and len(want) > 1000


def test_probing_holds_few_distances():
    """Batches of queries against many lists are cut: before, one batch went out whole, a vector for each list of each query."""
    centroids = np.random.default_rng(1).normal(size=(2000, 64))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    q = pa.FixedSizeListArray.from_arrays(pa.array(centroids[:300].ravel()), 64).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), q], ["id", "q"])
    sent = [b.num_rows for b in vector_index._probes(iter([batch]), centroids, np.full(2000, 2.0), None, -1.0)]
    assert sum(sent) == 300 * 2000 and max(sent) * 64 <= 2 * vector_index.AT_ONCE


# ---- years, lives, places, groups

def test_nearest_years_meet_no_rows(spark):
    """Of equal keys and years a row stands for all: ties by id on both sides, years before 0, nulls."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-260, 260, 37), -101, 0, 1, 101])) for i in rng.sample(range(1000), 150)]
    got = joins.nearest_years(spark.createDataFrame(rows, "id long, kind string, date_start int"), ["kind"], 3, 100).collect()
    want = set()
    for i, kind, year in rows:
        if kind is not None and year is not None:
            near = sorted((abs(y - year), j) for j, k, y in rows if k == kind and y is not None and abs(y - year) > 100)[:3]
            want |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    assert {(r.id, r.other_id, r["rank"]) for r in got} == want and len(got) == len(want) > 200


def test_lives_meet_no_events(spark):
    rng = random.Random(6)
    people = [(i, rng.choice([None, *range(-60, 60, 7)]), rng.choice([None, *range(-70, 90, 9)])) for i in range(90)]
    events = [(i, rng.choice([None, *range(-80, 90, 3)]), rng.choice([1, 4, 5, None])) for i in rng.sample(range(1000), 200)]
    df = joins.in_lifetime(spark.createDataFrame(people, "id long, birth_year int, death_year int"), spark.createDataFrame(events, "id long, date_start int, importance int"), 4, 30)
    want = set()
    for i, birth, death in people:
        if birth is not None:
            end = birth + 30 if death is None else death
            own = sorted((m is None, -(m or 0), y, j) for j, y, m in events if y is not None and birth <= y <= end)[:4]
            want |= {(i, j, y, None if none else -m, n + 1) for n, (none, m, y, j) in enumerate(own)}
    assert {tuple(r) for r in df.select("person_id", "event_id", "date_start", "importance", "rank").collect()} == want and len(want) > 100


def test_points_in_cells_are_not_broadcast(spark):
    """What stands in all its cells is many times larger than a plan thinks."""
    points = spark.range(3000).selectExpr("id", "cast(id % 170 - 85 as double) as latitude", "cast(id % 351 - 175 as double) as longitude")
    places = spark.range(20).selectExpr("id", "cast(id * 7 % 171 - 85 as double) as latitude", "cast(id * 17 % 351 - 175 as double) as longitude")
    plan = joins.nearest(points, places, 1500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    crowd = spark.range(3000).selectExpr("1 as k", "id")
    for df in (pairs.within(crowd, ["k"], "id"), pairs.between(crowd, crowd.withColumnRenamed("id", "other"), ["k"], ["id"], ["other"])):
        assert "strategy=merge" in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_groups_once(spark):
    rows = [(i, g) for i in range(40) for g in {i % 3, i % 4 if i % 5 == 0 else i % 3}] + [(3, 0), (None, 1), (7, None)]
    got = joins.same_group(spark.createDataFrame(rows, "id long, g int"), "g").collect()
    own = [(i, g) for i, g in rows if i is not None and g is not None]
    want = {(a, b) for a, g in own for b, h in own if g == h and a != b}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("km", [50.0, 700.0])
def test_greedy_places_in_batches(spark, km):
    from tests.test_changes import slow_greedy

    rng = random.Random(9)
    rows = [(i, rng.uniform(40, 48), rng.uniform(-4, 4)) for i in rng.sample(range(5000), 200)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    assert {r.id: r.seed for r in graph.greedy_places(df, km, first=9).collect()} == slow_greedy(rows, km)


def test_chain_of_one_person(spark):
    """The edges that stay with a person are found without those of people who share none."""
    rng = random.Random(2)
    some = lambda n: [(rng.randrange(n), rng.randrange(25)) for _ in range(120)]
    people, happened = (spark.createDataFrame(some(n), "entity_id long, source_id long") for n in (12, 30))
    events = spark.createDataFrame([(i, rng.choice([None, *range(9)])) for i in range(27)], "id long, date_start int")
    every = rows_of(graph.person_chain_edges(people, happened, events))
    assert len(every) > 40
    for p in (0, 3, 11, 99):
        got = graph.person_chain_edges(people, happened, events, of=p)
        at = sorted(got.columns).index("person_id")
        assert rows_of(got) == [r for r in every if r[at] == p]


def test_chains_are_shuffled_once_by_person(spark, data):
    """Pairs of a person and an event are many; before, they were shuffled for distinct, for dates, and twice by person."""
    t = Tables(spark, data)
    plan = knowledge.person_chain_edges(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(person_id") == plan.count("Exchange hashpartitioning(person_id#") == 1


def test_names_that_count_up(spark):
    """Grams of such names are all alike; what is left of them without a character is not."""
    names = [f"customer#{i:09d}" for i in range(0, 3000, 7)] + ["customer#", "customer#00000012", "customer#0000000123", "a", ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = {(r.a_s, r.b_s) for r in similar_strings.similar(df, df, 0.9).collect()}
    want = {(a, b) for a in names for b in names if strings.indel_ratio(a, b) >= 0.9}
    assert got == want
    met = similar_strings.candidates(df, df, 0.9).filter("length(a_s) = 18 and length(b_s) = 18").count()
    assert met == sum(len(a) == len(b) == 18 for a, b in want)  # no pair too many

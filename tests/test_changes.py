"""Versions, cascades, decisions that are resumed, expiring state, greedy places."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from annalum.operators import graph, windows
from annalum.sources import shared, sinks
from annalum.streaming import decisions, logs


# ---- versions

def test_versions_of_several_tables(spark, monkeypatch):
    path = shared.new_path(spark, "versions")
    a, b = spark.range(3), spark.range(5)
    assert sinks.publish_all({"a": a, "b": b}, path) == 1 and sinks.history_of(spark, path + "x", "a") is None
    assert sinks.publish_all({"a": spark.range(10, 12), "b": b}, path) == 2
    assert sinks.current_of(spark, path, "a").count() == 2 and sinks.history_of(spark, path, "a").count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish_all({"a": b, "b": b}, path, 2)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(a.write), "parquet", broken)
        with pytest.raises(RuntimeError):
            sinks.publish_all({"a": b, "b": b}, path)
    assert sinks.current_of(spark, path, "a").count() == 2


def test_two_writers_of_one_number(spark):
    path = shared.new_path(spark, "versions")
    assert sinks.publish(spark.range(3), path, 1) == 1
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(4), path, 1)
    assert sinks.current(spark, path).count() == 3 and sinks.children(spark, path) == ["v000000001"]


# ---- cascades

def test_cascade_by_brute_force(spark):
    rng = random.Random(4)
    people = [(i, rng.choice([None, *range(40)])) for i in range(40)]  # a table that refers to itself, in circles too
    books = [(i, rng.choice([None, *range(40)])) for i in range(60)]
    loans = [(rng.randrange(60), rng.randrange(3)) for _ in range(100)] + [(None, 1)]
    gone = {"people": {3, 4}, "books": {7}, "loans": set()}
    for _ in range(100):
        gone["people"] |= {i for i, boss in people if boss in gone["people"]}
        gone["books"] |= {i for i, p in books if p in gone["people"]}
    tables = {"people": spark.createDataFrame(people, "id long, boss long"), "books": spark.createDataFrame(books, "isbn long, author long"), "loans": spark.createDataFrame(loans, "isbn long, nth int"), "other": spark.range(3)}
    keys = {"people": ["id"], "books": ["isbn"], "loans": ["isbn", "nth"], "other": ["id"]}
    references = [("people", "boss", "people", "id"), ("books", "author", "people", "id"), ("loans", "isbn", "books", "isbn")]
    start = {"people": tables["people"].filter("id in (3, 4)"), "books": tables["books"].filter("isbn = 7")}
    done = sinks.cascade(tables, keys, references, start)
    assert {r.id for r in done["people"][1].collect()} == gone["people"] and len(gone["people"]) > 2
    assert {r.isbn for r in done["books"][1].collect()} == gone["books"]
    assert sorted(map(tuple, done["loans"][1].collect())) == sorted(x for x in loans if x[0] in gone["books"])
    assert done["loans"][0].count() + done["loans"][1].count() == len(loans) and done["other"][0].count() == 3
    version = sinks.publish_all({n: kept for n, (kept, _) in done.items()}, shared.new_path(spark, "library"))
    assert version == 1
    with pytest.raises(ValueError):
        sinks.cascade(tables, keys, [("x", "y", "people", "id")], start)


# ---- decisions

NAMES = ["Ada Lovelace", "ada lovelace ", "Ada Lovelac", "Grace Hopper", None, " ", "Grace Hoper", "Alan Turing", "ALAN TURING", "Ada Lovelace", "Allan Turing", "Emmy Noether"]


def mentions(spark, folder, ids):
    spark.createDataFrame([(i, NAMES[i]) for i in ids], "mention_id long, name string").coalesce(1).write.mode("append").parquet(folder)


def state(spark, path):
    return sorted(map(tuple, decisions.decisions(spark, path).select("mention_id", "decision", "owner_id").collect()), key=repr)


def run(spark, folder, path):
    stream = logs.log(spark, folder, "mention_id long, name string", files_per_batch=1)
    q = decisions.follow(stream, path)
    q.awaitTermination()


WANT = [(0, "CREATE", 0), (1, "LINK", 0), (2, "PENDING", 0), (3, "CREATE", 3), (4, "CREATE", None), (5, "CREATE", None), (6, "PENDING", 3), (7, "CREATE", 7), (8, "LINK", 7), (9, "LINK", 0), (10, "PENDING", 7), (11, "CREATE", 11)]


def test_decisions_of_a_stream(spark, tmp_path):
    folder, path = str(tmp_path / "in"), shared.new_path(spark, "decisions")
    for ids in ((0, 1), (2, 3, 4, 5), (6, 7, 8, 0, 3), (9, 10, 11)):  # 0 and 3 come twice
        mentions(spark, folder, ids)
        run(spark, folder, path)
    assert state(spark, path) == sorted(WANT, key=repr)
    assert {r.name for r in decisions.registry(spark, path).collect()} == {"ada lovelace", "grace hopper", "alan turing", "emmy noether"}
    assert sorted(r.mention_id for r in decisions.pending(spark, path).collect()) == [2, 6, 10]
    assert decisions.take(spark.createDataFrame([(99, "new")], "mention_id long, name string"), 2, path) is False  # a repeated batch
    decisions.resolve(spark.createDataFrame([(2, True), (6, False), (77, True)], "mention_id long, accepted boolean"), path)
    decisions.resolve(spark.createDataFrame([(2, False)], "mention_id long, accepted boolean"), path)  # decided already
    assert [r.mention_id for r in decisions.pending(spark, path).collect()] == [10]
    done = sinks.history_of(spark, f"{path}/resolved", "resolved")
    assert sorted((r.mention_id, r.decision, r.owner_id) for r in done.collect()) == [(2, "LINK", 0), (6, "CREATE", 6)]


def test_a_killed_batch_is_decided_again(spark, tmp_path, monkeypatch):
    """The second batch dies after its tables are written and before they are published; the query is started again."""
    folder, path = str(tmp_path / "in"), shared.new_path(spark, "decisions")
    mentions(spark, folder, (0, 1))
    run(spark, folder, path)
    mentions(spark, folder, (2, 3, 4, 5))
    real = sinks._at

    class Lost(Exception):
        pass

    def dies(s, where):
        if where.endswith("v000000002"):
            raise Lost
        return real(s, where)

    with monkeypatch.context() as m:
        m.setattr(sinks, "_at", dies)
        m.setattr(decisions, "finished", lambda *a: False)
        with pytest.raises(Exception, match="Lost"):
            run(spark, folder, path)
    left = sinks.children(spark, f"{path}/log")
    assert any(x.startswith(".new-") for x in left) and "v000000002" not in left
    assert len(state(spark, path)) == 2
    mentions(spark, folder, (6, 7, 8, 0, 3))
    mentions(spark, folder, (9, 10, 11))
    run(spark, folder, path)
    assert state(spark, path) == sorted(WANT, key=repr)


# ---- expiring state

def test_recent_counts_and_expiry(spark, tmp_path):
    """Rows in any order within the watermark give the counts of a window over all; then no key is left."""
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("abc"), start + dt.timedelta(seconds=rng.randrange(6 * 3600) + 120 * i)) for i in range(60)]
    rows += [(100 + i, "a", rows[5][2]) for i in range(3)]  # ties
    last = max(t for _, _, t in rows)
    schema, src = "id long, ip string, ts timestamp", str(tmp_path / "src")
    rng.shuffle(rows)
    for at in range(0, len(rows), 21):
        spark.createDataFrame(rows[at : at + 21], schema).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")

    def drain():
        q = logs.recent_counts(logs.log(spark, src, schema, files_per_batch=1), "ip", "ts", "id", 4, late="10 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    drain()
    for days in (1, 3):  # later rows of a key of their own move the watermark on
        spark.createDataFrame([(1000 + days, "z", last + dt.timedelta(days=days)), (None, None, last)], schema).coalesce(1).write.mode("append").parquet(src)
        held = drain()
    got = {r.id: (r.recent, r.refused) for r in spark.read.parquet(out).filter("ip <> 'z'").collect()}
    plain = windows.hourly_count(spark.createDataFrame(rows, schema).select("id", "ip", "ts"), "ip", "ts", 4, 1)
    want = {r.id: (r.recent, r.refused) for r in plain.collect()}
    assert got == want and any(x for _, x in want.values())
    assert held[-1] == 1  # the key that moved the watermark; those before have gone


# ---- greedy places

def slow_greedy(rows, km):
    def apart(a, b):
        x, y, z, w = map(math.radians, (a[1], b[1], a[2], b[2]))
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((w - z) / 2) ** 2)))

    placed = sorted(r for r in rows if r[1] and r[2])
    seed = {r[0]: None for r in rows if not (r[1] and r[2])}
    for r in placed:
        if r[0] not in seed:
            for other in placed:
                if other[0] not in seed and apart(r, other) <= km:
                    seed[other[0]] = r[0]
    return seed


def test_greedy_places(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, 0.0, rng.uniform(-90, 90), rng.uniform(40, 50), rng.uniform(40, 50)]), rng.choice([rng.uniform(-180, 180), rng.uniform(175, 180), rng.uniform(-180, -178), 10.0])) for i in rng.sample(range(10_000), 260)]
    rows += [(20_000 + i, *rows[i][1:]) for i in range(60)]  # the same places again
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double").repartition(5)
    for km in (200.0, 500.0, 3000.0):
        assert {r.id: r.seed for r in graph.greedy_places(df, km).collect()} == slow_greedy(rows, km)
    assert graph.greedy_places(df.limit(0)).count() == 0
    assert graph.greedy_places(df.select("id", F.lit(None).cast("double").alias("latitude"), "longitude")).filter("seed is null").count() == len(rows)


# ---- canonical names

def one_by_one(names):
    """The map in the order of ids, with Python's dicts."""
    import re

    def form(name):
        low = (name or "").lower().strip()
        for title in ("sir ", "king ", "queen "):
            if low.startswith(title):
                low = low[len(title) :]
                break
        for end in (" the great", " of camelot"):
            if low.endswith(end):
                low = low[: -len(end)]
                break
        return re.sub(r"\s+du\s+lac$", "", re.sub(r"\s+le\s+fay$", "", low)).strip()

    forms, keys, out = {}, {}, []
    for i, name, key in sorted(names):
        f = form(name)
        if f and f in forms:
            out.append((i, forms[f], "rule"))
            continue
        found = keys.get(key) if f and key else None
        out.append((i, i if found is None else found, "new" if found is None else "key"))
        if f:
            forms[f] = out[-1][1]
            if found is None and key:
                keys[key] = i
    return sorted(out)


def test_canonical_names_grow_in_order(spark, monkeypatch):
    from annalum.operators import canonical

    rng = random.Random(9)
    heads, names = ["Arthur", "Lancelot", "Morgan", "Galahad", "Gawain", "Bors", "Kay", "Tristan", "Isolde", None, " "], []
    for i in rng.sample(range(1000), 220):
        name = rng.choice(heads)
        if name and name.strip() and rng.random() < 0.5:
            name = rng.choice(["Sir ", "King ", ""]) + name + rng.choice([" of Camelot", " le Fay", " du Lac", "", f" {rng.randrange(4)}"])
        names.append((i, name, rng.choice([None, "", *(f"Q{k}" for k in range(14))])))
    df = spark.createDataFrame(names, "id long, name string, key string").repartition(4)
    want = one_by_one(names)
    assert {m for _, _, m in want} == {"new", "key", "rule"}
    got = lambda path: sorted((r.id, r.canonical_id, r.method) for r in canonical.resolutions(spark, path).collect())
    for batches in (1, 6):
        path = shared.new_path(spark, "canonical")
        canonical.resolve_all(df, path, batches)
        assert got(path) == want
    # A run that is lost in its third batch, and one that takes up from there.
    path, real = shared.new_path(spark, "canonical"), canonical.publish_all

    def lost(tables, where, number):
        if number == 3:
            raise RuntimeError("lost")
        return real(tables, where, number)

    with monkeypatch.context() as m:
        m.setattr(canonical, "publish_all", lost)
        with pytest.raises(RuntimeError):
            canonical.resolve_all(df, path, 5)
    assert 0 < len(got(path)) < len(want)
    canonical.resolve_all(df, path, 5)
    assert got(path) == want and canonical.add_batch(df, path, 2) is False

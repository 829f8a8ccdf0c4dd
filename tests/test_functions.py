"""Edge cases of functions and operators on hand-made rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalum.functions import geo, scores, text, years
from annalum.functions.python_only import slug, visible_text
from annalum.operators import filters, graph, joins, resolve, search, windows
from annalum.sources import files, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


@pytest.mark.parametrize(("year", "floor", "trunc"), [(-490, -500, -400), (-100, -100, -100), (-1, -100, 0), (0, 0, 0), (1, 0, 0), (99, 0, 0), (100, 100, 100), (None, None, None)])
def test_buckets(spark, year, floor, trunc):
    y = F.lit(year).cast("int")
    got = one(spark, f=years.bucket(y, 100), t=years.bucket(y, 100, "trunc"))
    assert (got["f"], got["t"]) == (floor, trunc)
    with pytest.raises(ValueError):
        years.bucket(y, 100, "other")


def test_labels_and_lives(spark):
    n = lambda x: F.lit(x).cast("int")
    got = one(spark, a=years.bucket_label(n(-400), 100), b=years.lifespan(n(-63), n(14)), c=years.lifespan(n(-63), n(-14)), d=years.lifespan(n(None), n(None)), e=years.lifespan(n(0), n(None)), f=years.alive(n(10), n(None), 90), g=years.alive(n(None), n(3), 1), h=years.display(n(-490), F.lit("century")))
    assert got == {"a": "400-301 BCE", "b": "63 BCE - 14 CE", "c": "63-14 BCE", "d": "Unknown", "e": "0 CE - ?", "f": True, "g": False, "h": "5th century BCE"}


def test_years_in_text(spark):
    got = one(spark, a=years.parsed(F.lit("-0490-01-01")), b=years.parsed(F.lit("1066")), c=years.parsed(F.lit("x")), d=years.mentioned(F.lit("in 490 BCE at")), e=years.mentioned(F.lit("none")))
    assert got == {"a": -490, "b": 1066, "c": None, "d": -490, "e": None}


@given(st.floats(-89, 89), st.floats(-179, 179), st.floats(-89, 89), st.floats(-179, 179))
@settings(max_examples=8, deadline=None)
def test_distance_is_a_distance(spark, a, b, c, d):
    got = one(spark, x=geo.haversine(a, b, c, d), y=geo.haversine(c, d, a, b), z=geo.haversine(a, b, a, b))
    assert abs(got["x"] - got["y"]) < 1e-6 and got["z"] == 0 and 0 <= got["x"] <= 20016


def test_scores(spark):
    n = lambda x: F.lit(x).cast("int")
    got = one(spark, a=scores.strength("causal", n(1), n(0)), b=scores.strength("person", n(1), n(None)), c=scores.direction(n(-5), n(5)), d=scores.direction(n(None), n(5)), e=scores.direction(n(0), n(-20)))
    assert got == {"a": 3.0, "b": 11.0, "c": "bidirectional", "d": "undirected", "e": "backward"}
    s, gap = scores.lifetime_overlap(n(100), n(150), n(None), n(None))
    assert one(spark, s=s, g=gap) == {"s": 0, "g": None}


def test_texts(spark):
    got = one(spark, a=text.plain_name(F.lit("King Arthur of Camelot")), b=text.royal(F.lit("Louis XIV"))[1], c=text.royal(F.lit("Medici"))[1], d=text.folded(F.lit("Straße Élan")), e=text.chunks(F.lit("abcdefghij"), 4, 1), f=text.chunks(F.lit(""), 4, 1), g=text.word_ngrams(F.lit("a bb ccc"), 1, 2, 3), h=text.tokens(F.lit("Roma 로마인 東京")))
    assert got["a"] == "arthur" and got["b"] == "XIV" and got["c"] == "" and got["d"] == "strasse elan"
    assert got["e"] == ["abcd", "defg", "ghij"] and got["f"] == [] and got["g"] == ["ccc", "a bb", "bb ccc"]
    assert got["h"] == ["roma", "로마", "마인", "로마인", "東京", "東京"]
    assert visible_text("<p>a<script>x</script> b</p><p>c") == "a b\nc" and visible_text(None) == "" and slug("Crème  Brûlée!") == "creme-brulee"


def test_filters(spark):
    df = spark.createDataFrame([("Mrs. X", 0), ("Plato", None), ("50% off", 5)], "name string, y int")
    assert df.filter(filters.every(None)).count() == 3
    assert [r.name for r in df.filter(filters.not_noise(F.col("name"))).collect()] == ["Plato", "50% off"]
    assert df.filter(filters.contains("%", F.col("name"))).count() == 1
    assert df.filter(filters.between(F.col("y"), 0, 0)).count() == 1


def test_nearest_crosses_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.5, 10.0), (3, 40.0, 0.0)], "id long, latitude double, longitude double")
    places = spark.createDataFrame([(7, 0.0, -179.9), (8, 89.5, -170.0)], "id long, latitude double, longitude double")
    for km in (120.0, 1500.0):
        assert {r.id: r.place_id for r in joins.nearest(points, places, km).collect()} == {1: 7, 2: 8}


def test_graph_walks(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (8, 9, 1.0), (4, 3, 0.1)], "a_id long, b_id long, strength double")
    assert {(r.node, r.depth) for r in graph.bfs(edges, 1, 5, 0.5).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    line = spark.createDataFrame([(i, i + 1) for i in range(40)], "a_id long, b_id long")
    assert {r.component for r in graph.components(line).collect()} == {0}
    assert [r.id for r in graph.follow(spark.createDataFrame([(1, 5), (1, 4), (4, 1)], "id long, next_id long"), 1, 3).orderBy("step").collect()] == [1, 4, 1, 4]


def test_bm25_repeats_terms_and_skips_nulls(spark):
    docs = spark.createDataFrame([(1, "war and peace"), (2, None), (3, "war war")], "id long, body string")
    once = {r.id: r.score for r in search.bm25(docs, "id", F.col("body"), ["war"]).collect()}
    twice = {r.id: r.score for r in search.bm25(docs, "id", F.col("body"), ["war", "war"]).collect()}
    assert set(once) == {1, 3} and all(abs(twice[i] - 2 * once[i]) < 1e-9 for i in once)
    assert search.bm25(docs, "id", F.col("body"), []).count() == 0
    assert {(r.id, r.term, r.tf) for r in search.postings(docs, "id", F.col("body")).collect()} >= {(3, "war", 2)}


def test_batches_are_anchored(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 60), ("a", 3, 120), ("a", 4, None), (None, 5, 7)], "g string, id long, y int")
    assert {(r.id, r.batch_start) for r in windows.anchored_batches(df, "g", "y", "id", 100).collect()} == {(1, 0), (2, 0), (3, 120), (5, 7)}


def test_fuzzy(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("martha", "marhta"), (None, "a")], "a string, b string")
    got = [(round(r.s, 4), round(r.j, 4)) for r in df.select(resolve.sequence_ratio("a", "b").alias("s"), resolve.jaro_winkler("a", "b").alias("j")).collect()]
    assert got[0][0] == 0.75 and got[1][1] == 0.9611 and got[2] == (0.0, 0.0)
    n = lambda x: F.lit(x).cast("double")
    assert one(spark, a=resolve.decide(n(0.9), n(0.85), F.lit(False)), b=resolve.decide(n(0.9), n(None), F.lit(False)), c=resolve.decide(n(0.99), n(None), F.lit(True))) == {"a": "PENDING", "b": "LINK", "c": "CREATE"}


def test_changes_of_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, x string, y int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", None)], "id long, x string, y int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["id"], ("y",)).collect()} == {(1, "a", None), (2, "B", 5), (3, "c", None)}
    assert {tuple(r) for r in sinks.insert_ignore(old, new, ["id"]).collect()} == {(1, "a", None), (2, "b", 5), (3, "c", None)}
    path = str(tmp_path / "t")
    sinks.replace(old, path)
    sinks.replace(sinks.delete(spark.read.parquet(path), new, ["id"]), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbad\n{"x": 2}\n')
    assert sorted(r.x for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 3}]')
    assert files.json_array(spark, str(tmp_path / "b.json"), schema="x int").count() == 2
    line = json.dumps({"custom_id": "k", "response": {"body": {"choices": [{"message": {"content": json.dumps({"year": -5})}}]}}})
    got = files.envelopes(spark.createDataFrame([(line,), ("{}",)], "value string"), "value", "year int").collect()
    assert [(r.custom_id, r.year) for r in got] == [("k", -5)]
    (tmp_path / "c.tsv").write_text("1\tRome\t2\n2\trome\t1\n")
    assert [r.id for r in files.tsv_first_wins(spark, str(tmp_path / "c.tsv"), "id int, name string, n int", "name", "id").collect()] == [1]
    (tmp_path / "d.json").write_text(json.dumps({"@graph": [{"id": "1", "title": "Roma", "reprPoint": [12.5, 41.9], "names": [{"romanized": "Rhome", "attested": None}]}, {"id": "2", "title": "X", "reprPoint": None, "names": None}]}))
    assert {(r.name, r.latitude) for r in files.json_ld_names(spark, str(tmp_path / "d.json")).collect()} == {("Roma", 41.9), ("Rhome", 41.9), ("X", None)}


def test_visible_text():
    from annalum.functions.python_only import visible_text

    page = "<!DOCTYPE html><head><style>p {a: b < c}</style></head><nav>menu <b>x</b></nav><p>One<sup>1</sup> &amp;  two<br/>three</p><!-- <p>gone</p> --><script>if (a<b) {'</div>'}</script><div>\n\n  four<aside>no</aside></div>end<header>never closed"
    assert visible_text(page) == "One & two\nthree\n\nfour\nend"
    assert visible_text(None) == visible_text("") == "" and visible_text("<sub>a</sub>b<SUP>c</SUP>") == "b"


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    assert sinks.publish(spark.range(2), path) == 1 and sinks.publish(sinks.current(spark, path).filter("id > 0"), path) == 2
    (tmp_path / "t" / "v000000003").mkdir()  # a writer that died
    assert [r.id for r in sinks.current(spark, path).collect()] == [1]
    assert sinks.publish(spark.range(5), path) == 4 and sinks.current(spark, path).count() == 5


def test_components_with_a_hub(spark, monkeypatch):
    """Edges folded a batch at a time and all at once."""
    star = [(0, i) for i in range(1, 700)] + [(i, i + 1000) for i in range(1, 700)] + [(5000, 5001), (7, 7), (8000, 8000)]
    for fold in (1, 500_000):
        monkeypatch.setattr(graph, "FOLD", fold)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(star, "a_id long, b_id long").repartition(7)).collect()}
        assert len(got) == 700 + 699 + 2 + 1 and got[8000] == 8000 and got[5001] == 5000
        assert {c for n, c in got.items() if n < 5000} == {0}
    assert graph.components(spark.createDataFrame([], "a_id long, b_id long")).count() == 0


def test_registry_decisions(spark):
    rows = [(1, "Louis XIV"), (2, " louis xiv"), (3, "Louis XV"), (4, None), (5, "Louis"), (6, "Louise"), (7, "abc def"), (8, "abc defg"), (9, "")]
    got = {r.id: (r.match_id, round(r.score, 3), r.decision) for r in resolve.registry_decisions(spark.createDataFrame(rows, "id long, name string")).collect()}
    assert got[1] == got[3] == (None, 0.0, "CREATE") and got[2] == (1, 0.95, "LINK") and got[4] == got[9] == (None, 0.0, "CREATE")
    assert got[5][2] == "PENDING" and got[6] == (None, 0.0, "CREATE") and got[8] == (7, 0.857, "LINK")


def test_five_stages(spark):
    asked = spark.createDataFrame([(1, "Rome", None), (2, "urbs", "Q1"), (3, "x", "Q2"), (4, "y", None), (5, "z", None), (6, None, None)], "id long, name string, key string")
    near = spark.createDataFrame([(4, 8, 0.96, False), (4, 7, 0.96, False), (5, 9, 0.92, True), (5, 3, 0.94, False), (6, 9, 0.89, True)], "id long, match_id long, similarity double, verified boolean")
    names, aliases = spark.createDataFrame([(20, "rome"), (10, "ROME")], "id long, name string"), spark.createDataFrame([(30, "Urbs")], "entity_id long, alias string")
    keys = spark.createDataFrame([(40, "Q2"), (41, "Q1")], "entity_id long, key string")
    got = {r.id: (r.match_id, r.stage, r.confidence) for r in resolve.five_stage_match(asked, names, aliases, keys, near).collect()}
    assert got == {1: (10, "exact", 1.0), 2: (30, "alias", 0.95), 3: (40, "key", 0.98), 4: (7, "vector", 0.96), 5: (9, "verified", 0.92), 6: (None, "none", 0.0)}

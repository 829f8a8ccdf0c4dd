"""Names in texts and split pairs against plain loops."""

import random

from pyspark.sql import functions as F

from annalum.operators import joins, mentions, pairs


def counts(df):
    return {(r.id, r.name): r["count"] for r in df.collect()}


def test_overlapping_and_nested_names(spark):
    rng = random.Random(3)
    names = ["a", "ab", "ABA", "bab", "abab", "b", "c a", " ", "aba", "é", None, "", "zzzz"]
    texts = [(i, "".join(rng.choice("abABé c") for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (82, "ab" * 40_000)]
    docs = spark.createDataFrame(texts, "id long, body string")
    listed = spark.createDataFrame([(n, 1) for n in names], "name string, id int")
    want = {(i, n): t.lower().count(n) for i, t in texts if t for n in {n.lower() for n in names if n} if n in t.lower()}
    for most in (10**6, 8, 1):  # one automaton, several, one a name
        assert counts(mentions.name_counts(docs, ["id"], "body", listed, most_chars=most)) == want
    assert mentions.name_counts(docs, ["id"], "body", listed.limit(0)).count() == 0
    assert mentions.name_counts(docs.limit(0), ["id"], "body", listed).count() == 0
    twice = docs.filter("id = 82").union(docs.filter("id = 82"))
    assert mentions.name_counts(twice, ["id"], "body", listed.filter("name = 'ab'")).count() == 2


def test_whole_words(spark):
    docs = spark.createDataFrame([(1, "Ring, rings; ring-a string ring"), (2, "éring ring_x"), (3, "ring")], "id long, body string")
    listed = spark.createDataFrame([("ring",), ("ring-a",)], "name string")
    assert counts(mentions.name_counts(docs, ["id"], "body", listed, whole_words=True)) == {(1, "ring"): 3, (1, "ring-a"): 1, (3, "ring"): 1}


def test_content_edges(spark):
    names = [("person", 1, "Alice Ames"), ("person", 2, "Alice Ames"), ("person", 3, "Bobby"), ("event", 9, "The Flood"), ("location", 5, "Aliceville"), ("event", 4, "Bobby"), ("person", 6, "Al")]
    long = " and more" * 20
    texts = [("alice ames", "Bobby saw Alice Ames, Bobby and the flood" + long), ("Bobby", "ALICE AMES at aliceville, alice ames" + long), ("The Flood", "bobby"), ("nobody", "bobby" + long), (None, None)]
    got = mentions.content_edges(spark.createDataFrame(texts, "title string, content string"), spark.createDataFrame(names, "kind string, id long, name string"))
    assert sorted(map(tuple, got.collect())) == [
        ("person", 2, "event", 4, 2), ("person", 2, "event", 9, 1), ("person", 2, "person", 3, 2), ("person", 3, "location", 5, 1)]


def test_keyword_lists(spark):
    books = spark.createDataFrame([(1, "The Iliad of Homer"), (2, "Homer and the odyssey"), (3, None)], "id long, title string")
    lists = spark.createDataFrame([("h", "iliad"), ("h", "HOMER"), ("o", "odyssey"), ("o", "none"), ("o", None)], "figure string, keyword string")
    got = mentions.keyword_matches(books, "id", "title", lists)
    assert sorted(map(tuple, got.collect())) == [("h", 1, 2, 2), ("h", 2, 1, 1), ("o", 2, 1, 1)]


def hot(spark, big, small):
    rows = [(0, i, i % 5) for i in range(big)] + [(k, i, 1) for k in range(1, 30) for i in range(k % small)] + [(None, 1, 1), (None, 2, 1)]
    return spark.createDataFrame(rows, "k int, id long, v int")


def test_pairs_within_and_between(spark):
    rows = hot(spark, 90, 7)
    plain = rows.alias("a").join(rows.alias("b"), "k").filter("a.id < b.id").selectExpr("k", "a.id", "a.v", "b.id", "b.v")
    other = rows.selectExpr("k", "id as x")
    plain_two = rows.join(other, "k").select("k", "id", "v", "x")
    for block in (4, 25, 1000):
        assert sorted(map(tuple, pairs.within(rows, ["k"], "id", ["v"], block).collect())) == sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, pairs.between(rows, other, ["k"], ["id", "v"], ["x"], block).collect())) == sorted(map(tuple, plain_two.collect()))
    assert pairs.within(rows.limit(0), ["k"], "id").count() == 0


def test_a_busy_source_is_dealt_out(spark):
    """100,000 mentions in one source, of 2,000 entities: its pairs are the same, and no cell has over four times the median."""
    rows = spark.range(100_000).select(F.lit(1).alias("source_id"), (F.col("id") * 7919 % 2000).alias("entity_id"))
    few = spark.createDataFrame([(s, e) for s in range(2, 60) for e in (1, 2, 3)], "source_id int, entity_id long")
    got = joins.co_mention_pairs(rows.union(few))
    assert got.count() == 2000 * 1999 // 2 and got.filter("a_id = 1 and b_id = 2").first().sources == 59
    own = rows.distinct().select(F.col("source_id"), F.col("entity_id").alias("id"))
    cut = pairs._cut(own, ["source_id"], 128)
    placed = pairs._with_blocks(own, cut, ["source_id"], True, "_n").withColumn("_own", pairs._own(["id"], "_n"))
    sizes = sorted(r["count"] for r in placed.groupBy("_own").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2]

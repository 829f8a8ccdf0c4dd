"""Names in texts, figures and their books, pairs of busy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions import text
from annalum.operators import mentions
from annalum.plans.catalog import query
from annalum.schema import Tables


def _words(c: str | Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), first, n), " ")


def _names(t: Tables) -> DataFrame:
    """kind, id, name: events, people, places, and works by their first one, two and three words."""
    each = [t.event.select(F.lit("event").alias("kind"), "id", F.col("title").alias("name")), t.person.select(F.lit("person"), "id", "name"), t.location.select(F.lit("location"), "id", "name")]
    each += [t.benchmark.select(F.lit(f"work{n}"), F.col("item_id").alias("id"), _words("text", 1, n)) for n in (1, 2, 3)]
    out = each[0]
    for more in each[1:]:
        out = out.union(more.toDF(*out.columns))
    return out


_NAMES = """names AS (SELECT 'event' AS kind, id::BIGINT AS id, title AS name FROM event UNION ALL SELECT 'person', id, name FROM person UNION ALL SELECT 'location', id, name FROM location
  UNION ALL SELECT 'work' || n, item_id, array_to_string(string_split(text, ' ')[1:n], ' ') FROM benchmark, range(1, 4) r(n))"""
_COUNT = "((length(t) - length(replace(t, n, ''))) / length(n))::BIGINT"


@query(f"""WITH {_NAMES}, n AS (SELECT DISTINCT lower(name) AS n FROM names WHERE name <> ''), d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS name, {_COUNT} AS count FROM d JOIN n ON contains(t, n)""")
def content_mentions(t: Tables) -> DataFrame:
    """Every name that a document holds, as a part of words too, and how often; names lie in one another."""
    return mentions.name_counts(t.documents, ["doc_id"], "text", _names(t).select("name"))


_PAGES = """p AS (SELECT page_id AS id, ['person', 'event', 'location'][page_id % 3 + 1] AS kind, array_to_string(string_split(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), ' ')[1:2], ' ') AS name, html FROM pages)"""


@query(f"""WITH {_PAGES}, k AS (SELECT kind, lower(name) AS n, max(id) AS id FROM p WHERE length(name) >= 5 GROUP BY ALL),
o AS (SELECT n, arg_min(kind, CASE kind WHEN 'person' THEN 0 WHEN 'event' THEN 1 ELSE 2 END) AS kind, arg_min(id, CASE kind WHEN 'person' THEN 0 WHEN 'event' THEN 1 ELSE 2 END) AS id FROM k GROUP BY 1),
a AS (SELECT o.kind AS fk, o.id AS fi, lower(html) AS t FROM p JOIN o ON lower(p.name) = o.n WHERE length(html) >= 100),
m AS (SELECT fk, fi, k.kind AS tk, k.id AS ti, {_COUNT} AS c FROM a JOIN k ON contains(t, n) WHERE fk <> k.kind OR fi <> k.id)
SELECT fk AS from_kind, CASE WHEN fk = tk THEN least(fi, ti) ELSE fi END AS from_id, tk AS to_kind, CASE WHEN fk = tk THEN greatest(fi, ti) ELSE ti END AS to_id, max(c) AS count FROM m GROUP BY ALL""")
def content_mention_edges(t: Tables) -> DataFrame:
    """Edges from a page about someone to whom its text mentions; a page is about whom its title begins with."""
    pages = t.pages.withColumn("name", _words(text.title(F.col("html")), 1, 2))
    kind = F.element_at(F.array(F.lit("person"), F.lit("event"), F.lit("location")), (F.col("page_id") % 3 + 1).cast("int"))
    names = pages.select(kind.alias("kind"), F.col("page_id").alias("id"), "name")
    return mentions.content_edges(pages.select(F.col("name").alias("title"), F.col("html").alias("content")), names)


@query("""WITH k AS (SELECT DISTINCT item_id % 12 AS figure, lower(w) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')[2:4]) AS w FROM benchmark) WHERE length(w) >= 5),
d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT figure, doc_id, count(*) AS keywords FROM (SELECT figure, doc_id, n FROM d JOIN k ON contains(t, n)) GROUP BY 1, 2 HAVING count(*) >= 2""")
def figure_books(t: Tables) -> DataFrame:
    """Which documents hold at least two of a figure's keywords; every figure has a list of its own."""
    listed = t.benchmark.select((F.col("item_id") % 12).alias("figure"), F.explode(F.slice(F.split("text", " "), 2, 3)).alias("keyword")).filter(F.length("keyword") >= 5)
    return mentions.keyword_matches(t.documents, "doc_id", "text", listed, 2).select("figure", "doc_id", "keywords")

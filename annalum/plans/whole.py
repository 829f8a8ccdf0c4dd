"""Rules in full: evidence sets, typed links, mentions between events, people alive, causal stories, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions import text
from annalum.operators import canonical, graph, mentions, pairs, resolve, search, stories, vector_index
from annalum.operators.windows import top_n
from annalum.plans.catalog import query
from annalum.plans.complete import _YEAR
from annalum.plans.knowledge import _CAUSAL, causal
from annalum.plans.queries import _long
from annalum.schema import Tables
from annalum.sources import shared

# ---- evidence


def evidence_sets(links: DataFrame, persons: DataFrame, events: DataFrame, limits: tuple[int, int, int] = (50, 30, 20), width: int = 100) -> DataFrame:
    """person_id, evidence, event_id, rank: of every person the first direct events of the period, the first direct ones of
    other times, and the first of the period at the person's place that have no link, each by date.

    A period is 20 years before birth to 30 after death (80 after birth where that is unknown). Places and years meet by
    blocks, and busy blocks are split. links: person_id, event_id; persons with place_id; events with location_id.
    """
    low, high = F.col("birth_year") - 20, F.coalesce("death_year", F.col("birth_year") + 80) + 30
    lives = persons.filter("birth_year is not null").select(F.col("id").alias("person_id"), "place_id", low.alias("low"), high.alias("high"))
    dated = events.filter("date_start is not null").select(F.col("id").alias("event_id"), "date_start", "location_id")
    direct = links.select("person_id", "event_id").distinct()
    known = direct.join(lives, "person_id").join(dated, "event_id").withColumn("inside", F.col("date_start").between(F.col("low"), F.col("high")))
    block = lambda c: F.floor(c / width).cast("long")
    seen = lives.filter("low <= high").withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high"))))).withColumnRenamed("place_id", "location_id")
    here = dated.withColumn("block", block(F.col("date_start")))
    around = pairs.between(seen, here, ["location_id", "block"], ["person_id", "low", "high"], ["event_id", "date_start"]).filter("date_start between low and high")
    context = around.join(direct, ["person_id", "event_id"], "left_anti")
    order = [F.asc("date_start"), F.asc("event_id")]
    parts = [("direct_period", known.filter("inside")), ("direct_other", known.filter("not inside")), ("context", context)]
    found = [top_n(df.select("person_id", "event_id", "date_start"), ["person_id"], order, n).withColumn("evidence", F.lit(kind)) for (kind, df), n in zip(parts, limits, strict=True)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("person_id", "evidence", "event_id", "rank")


@query("""WITH l AS (SELECT DISTINCT p.entity_id AS person_id, e.entity_id AS event_id FROM mention p JOIN mention e ON p.source_id = e.source_id AND p.chunk_index = e.chunk_index AND p.entity_type = 'person' AND e.entity_type = 'event'),
q AS (SELECT id AS person_id, nation_id, birth_year - 20 AS low, coalesce(death_year, birth_year + 80) + 30 AS high FROM person),
a AS (SELECT q.person_id, e.id AS event_id, date_start, CASE WHEN l.event_id IS NULL THEN 'context' WHEN date_start BETWEEN low AND high THEN 'direct_period' ELSE 'direct_other' END AS evidence
  FROM q JOIN event e ON TRUE LEFT JOIN l ON l.person_id = q.person_id AND l.event_id = e.id WHERE l.event_id IS NOT NULL OR (date_start BETWEEN low AND high AND location_id = nation_id))
SELECT person_id, evidence, event_id, row_number() OVER (PARTITION BY person_id, evidence ORDER BY date_start, event_id) AS rank FROM a
QUALIFY rank <= CASE evidence WHEN 'direct_period' THEN 50 WHEN 'direct_other' THEN 30 ELSE 20 END""")
def person_evidence_sets(t: Tables) -> DataFrame:
    mentioned = lambda kind: t.mentions(kind).select("source_id", "chunk_index", F.col("entity_id").alias(f"{kind}_id")).distinct()
    links = pairs.between(mentioned("person"), mentioned("event"), ["source_id", "chunk_index"], ["person_id"], ["event_id"])
    found = evidence_sets(links, t.person.withColumnRenamed("nation_id", "place_id"), t.event)
    return found.select("person_id", "evidence", "event_id", *_long("rank"))


# ---- pages and what they link and mention

_PAGES = """p AS (SELECT page_id AS id, ['person', 'event', 'location'][page_id % 3 + 1] AS kind, '/' || lower(split_part(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), ' ', 1)) AS name,
  list_distinct(list_transform(regexp_extract_all(html, '<a [^>]*href="([^"#]+)', 1), lambda x: lower(x))) AS links, html FROM pages)"""
_EDGE = "CASE {} WHEN 'event' THEN 0 WHEN 'person' THEN 1 ELSE 2 END"


def _pages(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("person"), F.lit("event"), F.lit("location")), (F.col("page_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("/"), F.lower(F.split_part(text.title(F.col("html")), F.lit(" "), F.lit(1))))
    return t.pages.select(F.col("page_id").alias("id"), kind.alias("kind"), name.alias("name"), text.links(F.col("html")).alias("links"), "html")


@query(f"""WITH {_PAGES}, k AS (SELECT kind, name, max(id) AS id FROM p GROUP BY ALL),
n AS (SELECT name, arg_min(kind, CASE kind WHEN 'person' THEN 0 WHEN 'event' THEN 1 ELSE 2 END) AS kind, arg_min(id, CASE kind WHEN 'person' THEN 0 WHEN 'event' THEN 1 ELSE 2 END) AS id FROM k GROUP BY 1),
e AS (SELECT p.kind AS fk, p.id AS fi, n.kind AS tk, n.id AS ti FROM (SELECT kind, id, unnest(links) AS link FROM p) p JOIN n ON n.name = link WHERE NOT (p.kind = n.kind AND (p.id = n.id OR p.kind = 'location'))),
o AS (SELECT *, {_EDGE.format('fk')} AS f, {_EDGE.format('tk')} AS g FROM e)
SELECT DISTINCT CASE WHEN f > g THEN tk ELSE fk END AS from_kind, CASE WHEN f > g OR (f = g AND fi > ti) THEN ti ELSE fi END AS from_id, CASE WHEN f > g THEN fk ELSE tk END AS to_kind, CASE WHEN f > g OR (f = g AND fi > ti) THEN fi ELSE ti END AS to_id FROM o""")
def typed_page_links(t: Tables) -> DataFrame:
    """Edges between people, events and places from the links of their pages."""
    pages = _pages(t)
    return graph.typed_links(pages.select("kind", "id", "links"), pages.select("kind", "id", "name"))


def event_mentions(pages: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """a_id, b_id (a_id < b_id): events whose page links to the other's title or holds it in whole words. pages: id, links,
    content; names: id, name, of equal names the largest id."""
    known = names.filter(F.length("name") >= least).groupBy(F.lower("name").alias("name")).agg(F.max("id").alias("other"))
    linked = pages.select("id", F.explode(F.array_distinct(F.transform("links", F.lower))).alias("name")).join(known, "name").select("id", "other")
    held = mentions.name_counts(pages.select("id", "content"), ["id"], "content", known.select("name"), whole_words=True).join(known, "name").select("id", "other")
    met = linked.union(held).filter("id <> other")
    return met.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()


@query(f"""WITH {_PAGES}, e AS (SELECT * FROM p WHERE kind <> 'location'), n AS (SELECT name, max(id) AS other FROM e WHERE length(name) >= 5 GROUP BY 1),
m AS (SELECT id, other FROM (SELECT id, unnest(links) AS name FROM e) JOIN n USING (name) UNION SELECT id, other FROM e JOIN n ON regexp_matches(lower(html), regexp_escape(n.name) || CASE WHEN regexp_matches(n.name, '[\\p{{L}}\\p{{N}}_]$') THEN '($|[^\\p{{L}}\\p{{N}}_])' ELSE '' END))
SELECT DISTINCT least(id, other) AS a_id, greatest(id, other) AS b_id FROM m WHERE id <> other""")
def event_mention_edges(t: Tables) -> DataFrame:
    """Pages that link to or name one another."""
    some = _pages(t).filter("kind <> 'location'")
    return event_mentions(some.select("id", "links", F.col("html").alias("content")), some.select("id", "name"))


# ---- people alive, stories, decisions

@query("""SELECT id, name FROM person WHERE birth_year <= 100 AND (death_year >= 100 OR death_year IS NULL) AND id IN (SELECT entity_id FROM mention WHERE entity_type = 'person' AND confidence >= 0.95)""")
def people_alive(t: Tables) -> DataFrame:
    """People alive in a year who are mentioned with confidence; noise and orphans are left out."""
    linked = t.mentions("person").filter("confidence >= 0.95").select(F.col("entity_id").alias("id"))
    return search.alive(t.person, 100, linked)


def _caused(c: str) -> Column:
    return F.when(F.col(c) % 5 != 0, (F.col(c) * 13 + 5) % 2000)


@query(f"""WITH RECURSIVE c AS (SELECT id, (id * 13 + 5) % 2000 AS next_id FROM event WHERE id % 5 <> 0),
w AS (SELECT id AS seed, 1 AS segment, id FROM event WHERE importance >= 5 UNION ALL SELECT seed, segment + 1, next_id FROM w JOIN c USING (id) WHERE segment < 10)
SELECT seed::BIGINT AS seed, id::BIGINT AS event_id, segment::BIGINT AS segment, title || ' occurred in ' || {_YEAR} || '.' AS narrative, CASE WHEN segment > 1 THEN 'causes' END AS connection FROM w JOIN event USING (id)""")
def causal_stories(t: Tables) -> DataFrame:
    """The story of what every important event led to, ten events at most."""
    successors = t.event.select("id", _caused("id").alias("next_id")).filter("next_id is not null")
    chain = graph.follow_all(successors, t.event.filter("importance >= 5").select("id"))
    named = chain.join(t.event.select("id", "title", "date_start"), "id").withColumn("subject", F.lit(""))
    return stories.told("event", named, "subject").select(*_long("seed"), F.col("id").cast("long").alias("event_id"), *_long("segment"), "narrative", "connection")


@query("""WITH q AS (SELECT id::BIGINT AS id, CASE WHEN id % 3 = 0 THEN category || ' ' || brand ELSE title || ' ' || id END AS name FROM event),
n AS (SELECT lower(name) AS k, min(id) AS first_id FROM q GROUP BY 1), a AS (SELECT lower(category || ' ' || brand) AS k, min(id) AS alias_id FROM event WHERE id % 3 = 1 GROUP BY 1)
SELECT q.id, CASE WHEN q.id > first_id THEN first_id ELSE alias_id END AS match_id, CASE WHEN q.id > first_id THEN 0.95 ELSE 0.9 END::DOUBLE AS score
FROM q JOIN n ON n.k = lower(name) LEFT JOIN a ON a.k = lower(name) WHERE q.id > first_id OR alias_id < q.id""")
def registry_alias_decisions(t: Tables) -> DataFrame:
    """Links by equal name and by alias; the rest of the decisions stands in registry_decisions."""
    own = F.concat_ws(" ", "category", "brand")
    names = t.event.select(*_long("id"), F.when(F.col("id") % 3 == 0, own).otherwise(F.concat_ws(" ", "title", "id")).alias("name"))
    aliases = t.event.filter("id % 3 = 1").select(F.col("id").cast("long").alias("entity_id"), own.alias("alias"))
    return resolve.registry_links(names, aliases).select("id", "match_id", "score")


@query("""WITH n AS (SELECT id, trim(CASE id % 4 WHEN 0 THEN title WHEN 1 THEN title || ' ' || id % 9 ELSE category || ' ' || id % 60 END) AS form, CASE WHEN id % 3 = 0 THEN brand || id % 7 END AS key FROM event),
f AS (SELECT form, min(id) AS first_id, arg_min(coalesce(key, ''), id) AS key FROM n GROUP BY 1), k AS (SELECT key, min(first_id) AS key_id FROM f WHERE key <> '' GROUP BY 1),
h AS (SELECT lower(form) AS form, first_id, coalesce(key_id, first_id) AS canonical_id FROM f LEFT JOIN k USING (key))
SELECT id::BIGINT AS id, canonical_id::BIGINT AS canonical_id, CASE WHEN id <> first_id THEN 'rule' WHEN id = canonical_id THEN 'new' ELSE 'key' END AS method FROM n JOIN h ON lower(n.form) = h.form""")
def canonical_names(t: Tables) -> DataFrame:
    """Every event's name, in four batches, against the canonical names of those before it."""
    kind = F.col("id") % 4
    plain = F.when(kind == 0, F.col("title")).when(kind == 1, F.concat_ws(" ", "title", F.col("id") % 9)).otherwise(F.concat_ws(" ", "category", F.col("id") % 60))
    key = F.when(F.col("id") % 3 == 0, F.concat("brand", (F.col("id") % 7).cast("string")))
    named = t.event.select(F.col("id").cast("long").alias("id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("Sir "), plain)).when(F.col("id") % 5 == 1, F.concat(plain, F.lit(" du Lac"))).otherwise(plain).alias("name"), key.alias("key"))
    return canonical.resolve_all(named, shared.new_path(t.spark, "canonical"), 4).select("id", "canonical_id", "method")


# ---- walks and retrieval

@query(f"""WITH RECURSIVE {_CAUSAL}, d AS (SELECT a_id, b_id, strength FROM edge UNION ALL SELECT b_id, a_id, strength FROM edge),
b AS (SELECT a_id, b_id FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY strength DESC, b_id) <= 3),
w AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT b.b_id, depth + 1 FROM w JOIN b ON b.a_id = w.node WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def bfs_fan_out(t: Tables) -> DataFrame:
    """A walk over causal edges in which every event follows its three strongest."""
    return graph.bfs(causal(t), 7, 4, fan_out=3)


def retrieved(found: DataFrame, documents: DataFrame, most: int = 5) -> DataFrame:
    """id, confidence, sources, context of every question: the titles of its nearest documents by rank, as numbered lines, and
    the largest similarity as confidence. found: id, candidate_id, similarity, rank; documents: id, title."""
    named = found.filter(F.col("rank") <= most).join(documents.select(F.col("id").alias("candidate_id"), "title"), "candidate_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title")
    out = named.groupBy("id").agg(F.max("similarity").alias("confidence"), F.count("*").alias("sources"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return out.select("id", "confidence", "sources", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


@query("""WITH c AS (SELECT a.vec_id AS id, b.vec_id AS c, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, c) AS rank FROM c WHERE s >= 0.25 QUALIFY rank <= 5)
SELECT r.id, round(max(s), 6) AS confidence, count(*) AS sources, string_agg('[' || rank || '] ' || title, chr(10) ORDER BY rank) AS context FROM r JOIN event e ON e.id = r.c GROUP BY 1""")
def retrieved_contexts(t: Tables) -> DataFrame:
    """For questions given by vectors: the context and the confidence of an answer."""
    index = vector_index.index_of(t.embeddings, "vec_id", "embedding", 64, "embeddings")
    found = index.candidates(t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, 0.25)
    out = retrieved(found, t.event.select(*_long("id"), "title"))
    return out.withColumn("confidence", F.round("confidence", 6))

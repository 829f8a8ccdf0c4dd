"""Queries of the knowledge model: graphs, search, texts, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.functions import scores, text, years
from annalum.operators import bm25_index, graph, joins, pairs, resolve, search, vector_index
from annalum.operators.windows import top_n
from annalum.plans.catalog import query
from annalum.plans.queries import _long
from annalum.schema import Tables

_FACTOR = "{n} * power(1 + ln({n}::DOUBLE), 1.5)"
_DIRECTION = "CASE WHEN b_year - a_year IS NULL THEN 'undirected' WHEN abs(b_year - a_year) <= 10 THEN 'bidirectional' WHEN b_year - a_year > 10 THEN 'forward' ELSE 'backward' END"
_CAUSAL = f"""o AS (SELECT DISTINCT entity_id, source_id FROM mention WHERE entity_type = 'event'),
c AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, count(*) AS sources FROM o a JOIN o b ON a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY ALL),
y AS (SELECT c.*, ea.date_start AS a_year, eb.date_start AS b_year FROM c JOIN event ea ON ea.id = a_id JOIN event eb ON eb.id = b_id),
edge AS (SELECT a_id, b_id, sources, abs(b_year - a_year)::BIGINT AS distance, {_DIRECTION} AS direction, round(1.0 + {_FACTOR.format(n='sources')} + greatest(0.0, (50 - abs(b_year - a_year)) * 0.02::DOUBLE), 6) AS strength FROM y)"""


# ---- graphs

def causal(t: Tables) -> DataFrame:
    return graph.causal_edges(t.mentions("event"), t.event)


@query(f"WITH {_CAUSAL} SELECT * FROM edge")
def causal_edges(t: Tables) -> DataFrame:
    return causal(t).select("a_id", "b_id", "sources", *_long("distance"), "direction", "strength")


def _chain_sql(base: float) -> str:
    return f"abs(b_year - a_year)::BIGINT AS distance, {_DIRECTION} AS direction, round({base} + 1.0 + greatest(0.0, (50 - abs(b_year - a_year)) * 0.02::DOUBLE), 6)::DOUBLE AS strength"


@query(f"""WITH p AS (SELECT DISTINCT entity_id AS person_id, source_id FROM mention WHERE entity_type = 'person'), v AS (SELECT DISTINCT entity_id AS id, source_id FROM mention WHERE entity_type = 'event'),
o AS (SELECT DISTINCT person_id, id FROM p JOIN v USING (source_id)), k AS (SELECT person_id, count(*) AS events FROM o GROUP BY 1),
s AS (SELECT person_id, id AS a_id, date_start AS a_year, lead(id) OVER w AS b_id, lead(date_start) OVER w AS b_year FROM o JOIN event USING (id) WINDOW w AS (PARTITION BY person_id ORDER BY date_start, id)),
f AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY events DESC, person_id) AS n FROM s JOIN k USING (person_id) WHERE b_id IS NOT NULL)
SELECT person_id, a_id, b_id, {_chain_sql(10.0)} FROM f WHERE n = 1""")
def person_chain_edges(t: Tables, of: int | None = None) -> DataFrame:
    return graph.person_chain_edges(t.mentions("person"), t.mentions("event"), t.event, of).select("person_id", "a_id", "b_id", *_long("distance"), "direction", "strength")


_BUSY = "location_id IN (SELECT location_id FROM event WHERE location_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, location_id LIMIT 1000)"


@query(f"""WITH s AS (SELECT location_id::BIGINT AS location_id, id AS a_id, date_start AS a_year, lead(id) OVER w AS b_id, lead(date_start) OVER w AS b_year FROM event WHERE {_BUSY} WINDOW w AS (PARTITION BY location_id ORDER BY date_start, id))
SELECT location_id, a_id, b_id, {_chain_sql(5.0)} FROM s WHERE b_id IS NOT NULL""")
def location_chain_edges(t: Tables) -> DataFrame:
    return graph.location_chain_edges(t.event).select(*_long("location_id"), "a_id", "b_id", *_long("distance"), "direction", "strength")


@query(f"WITH {_CAUSAL} SELECT e.a_id, a.title AS a_title, e.b_id, b.title AS b_title, strength FROM edge e JOIN event a ON a.id = a_id JOIN event b ON b.id = b_id WHERE strength >= 1.5 AND direction = 'forward' ORDER BY strength DESC, a_id, b_id LIMIT 50")
def edge_listing(t: Tables) -> DataFrame:
    top = causal(t).filter("strength >= 1.5 and direction = 'forward'").orderBy(F.desc("strength"), "a_id", "b_id").limit(50)
    names = lambda side: t.event.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"))
    return top.join(names("a"), "a_id").join(names("b"), "b_id").select("a_id", "a_title", "b_id", "b_title", "strength")


@query(f"WITH {_CAUSAL} SELECT 7::BIGINT AS a_id, CASE WHEN a_id = 7 THEN b_id ELSE a_id END AS b_id, strength FROM edge WHERE a_id = 7 OR b_id = 7")
def event_arcs(t: Tables) -> DataFrame:
    """Edges at an event, turned so that it is their source."""
    return graph.incident(causal(t).select("a_id", "b_id", "strength"), 7)


@query("""SELECT b.id, CASE WHEN abs(bl.latitude - al.latitude) < 1 AND abs(bl.longitude - al.longitude) < 1 THEN 'spatial' ELSE 'temporal' END AS kind
FROM event a LEFT JOIN location al ON a.location_id = al.id, event b LEFT JOIN location bl ON b.location_id = bl.id
WHERE a.id = 7 AND b.id <> 7 AND ((abs(bl.latitude - al.latitude) < 1 AND abs(bl.longitude - al.longitude) < 1) OR abs(b.date_start - a.date_start) < 50)""")
def neighbours(t: Tables) -> DataFrame:
    placed = t.event.join(t.location.select(F.col("id").alias("location_id"), "latitude", "longitude"), "location_id", "left")
    one = placed.filter("id = 7").select(F.col("latitude").alias("lat0"), F.col("longitude").alias("lng0"), F.col("date_start").alias("year0"))  # one row: id is a key
    near = F.coalesce((F.abs(F.col("latitude") - F.col("lat0")) < 1) & (F.abs(F.col("longitude") - F.col("lng0")) < 1), F.lit(False))
    return placed.filter("id <> 7").crossJoin(F.broadcast(one)).filter(near | (F.abs(F.col("date_start") - F.col("year0")) < 50)).select("id", F.when(near, "spatial").otherwise("temporal").alias("kind"))


_LOC_EDGES = f"""s AS (SELECT id AS a_id, lead(id) OVER (PARTITION BY location_id ORDER BY date_start, id) AS b_id, abs(lead(date_start) OVER (PARTITION BY location_id ORDER BY date_start, id) - date_start) AS gap FROM event WHERE {_BUSY}),
g AS (SELECT a_id, b_id FROM s WHERE b_id IS NOT NULL AND gap <= {{gap}})"""


def _near_chain(t: Tables, gap: int) -> DataFrame:
    return graph.location_chain_edges(t.event).filter(F.col("distance") <= gap).select("a_id", "b_id", "strength")


@query("WITH RECURSIVE " + _LOC_EDGES.format(gap=400) + """, b AS (SELECT a_id, b_id FROM g UNION SELECT b_id, a_id FROM g),
w AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT b.b_id, depth + 1 FROM w JOIN b ON b.a_id = w.node WHERE depth < 5) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def bfs_min_depth(t: Tables) -> DataFrame:
    return graph.bfs(_near_chain(t, 400), 7, 5)


@query("WITH RECURSIVE " + _LOC_EDGES.format(gap=150) + """, b AS (SELECT a_id, b_id FROM g UNION SELECT b_id, a_id FROM g),
w AS (SELECT DISTINCT a_id AS node, a_id AS root FROM b UNION SELECT b.b_id, root FROM w JOIN b ON b.a_id = w.node) SELECT node, min(root) AS component FROM w GROUP BY 1""")
def connected_components(t: Tables) -> DataFrame:
    return graph.components(_near_chain(t, 150).select("a_id", "b_id"))


@query("WITH " + _LOC_EDGES.format(gap=50) + """ SELECT id, title, date_start::BIGINT AS date_start, CASE WHEN importance >= 5 THEN 'major' ELSE 'minor' END AS kind FROM event WHERE id IN (SELECT a_id FROM g UNION SELECT b_id FROM g)""")
def story_nodes(t: Tables) -> DataFrame:
    return graph.story_nodes(_near_chain(t, 50), t.event).select("id", "title", *_long("date_start"), "kind")


@query("""WITH RECURSIVE n AS (SELECT id, (id * 7 + 3) % 2000 AS next_id FROM event WHERE id % 5 <> 0), w AS (SELECT 0 AS step, 11::BIGINT AS id UNION ALL SELECT step + 1, next_id FROM w JOIN n USING (id) WHERE step < 6) SELECT step::INT AS step, id FROM w""")
def causal_follow(t: Tables) -> DataFrame:
    return graph.follow(t.event.filter("id % 5 <> 0").select("id", ((F.col("id") * 7 + 3) % 2000).alias("next_id")), 11, 6)


@query("""SELECT a.id AS a_id, b.id AS b_id, CASE WHEN high - low >= 20 THEN 10 WHEN high - low >= 10 THEN 7 WHEN high >= low THEN 5 WHEN low - high <= 50 THEN 2 WHEN low - high <= 100 THEN 0 ELSE -5 END::BIGINT AS score, greatest(low - high, 0)::BIGINT AS apart
FROM (SELECT a.id AS aid, b.id AS bid, greatest(a.birth_year, b.birth_year) AS low, least(coalesce(a.death_year, a.birth_year + 70), coalesce(b.death_year, b.birth_year + 70)) AS high FROM person a JOIN person b ON a.nation_id = b.nation_id AND a.id < b.id) x JOIN person a ON a.id = aid JOIN person b ON b.id = bid""")
def relationship_strength(t: Tables) -> DataFrame:
    met = pairs.within(t.person, ["nation_id"], "id", ["birth_year", "death_year"])
    score, apart = scores.lifetime_overlap(F.col("a_birth_year"), F.col("a_death_year"), F.col("b_birth_year"), F.col("b_death_year"))
    return met.select("a_id", "b_id", score.cast("long").alias("score"), apart.cast("long").alias("apart"))


# ---- search and texts

def _bm25_sql(terms: list[str], k: int) -> str:
    return f"""k AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM k),
f AS (SELECT q.t, q.c, doc_id, len(w) AS n, len(list_filter(w, lambda x: x = q.t)) AS tf FROM k, (VALUES {', '.join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))}) q(t, c)),
d AS (SELECT t, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1),
bm AS (SELECT doc_id, sum(c * ln((docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean)))) AS score FROM f JOIN d USING (t), s WHERE tf > 0 GROUP BY 1),
bt AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= {k})"""


_TERMS = ["the", "worthless", "idiot", "the"]


@query(f"WITH {_bm25_sql(_TERMS, 20)} SELECT doc_id, score FROM bt")
def bm25_topk(t: Tables) -> DataFrame:
    """By the stored index of the documents, made when they are first searched."""
    return _searched(t, 20).select("doc_id", F.round("score", 6).alias("score"))


def _searched(t: Tables, k: int) -> DataFrame:
    found = bm25_index.index_of(t.documents.select("doc_id", "text"), "doc_id", "text", "documents")
    return found.search(_TERMS, k).withColumnRenamed("key", "doc_id")


_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VECTOR_SQL = f"vt AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, _VECTOR))}]::DOUBLE[]) AS s FROM embeddings)"


@query(f"WITH {_VECTOR_SQL} SELECT vec_id, round(s, 6) AS similarity FROM vt WHERE s >= 0.1 ORDER BY round(s, 9) DESC, vec_id LIMIT 15")
def vector_topk(t: Tables) -> DataFrame:
    """By the stored index of the vectors, the exact way."""
    return _vectors(t).topk(_VECTOR, 15, 0.1).select(F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def _vectors(t: Tables) -> vector_index.VectorIndex:
    return vector_index.index_of(t.embeddings, "vec_id", "embedding", 64, "embeddings")


@query("""SELECT id, candidate_id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, candidate_id) AS rank FROM
 (SELECT a.vec_id AS id, b.vec_id AS candidate_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE s >= 0.3) WHERE rank <= 10""")
def vector_neighbours(t: Tables) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, among all vectors, through the index, the exact way."""
    found = _vectors(t).candidates(t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, 0.3)
    return found.select("id", "candidate_id", *_long("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_bm25_sql(_TERMS, 20)}, {_VECTOR_SQL}, vr AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS rank FROM vt WHERE s >= 0 QUALIFY rank <= 20)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS lists FROM (SELECT doc_id, rank FROM bt UNION ALL SELECT doc_id, rank FROM vr) GROUP BY 1""")
def rrf_fusion(t: Tables) -> DataFrame:
    """Lists of 20 rows each are ranked and fused."""
    from pyspark.sql import Window as W

    ranked = lambda df, score: df.withColumn("rank", F.row_number().over(W.orderBy(F.round(score, 9).desc(), F.asc("doc_id"))))
    lexical = ranked(_searched(t, 20), "score")
    near = ranked(_vectors(t).topk(_VECTOR, 20, 0.0).withColumnRenamed("key", "doc_id"), "similarity")
    return search.rrf("doc_id", lexical, near).select("doc_id", F.round("score", 6).alias("score"), "lists")


@query("""SELECT DISTINCT a.label::BIGINT AS label, a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def near_duplicate_vectors(t: Tables) -> DataFrame:
    return search.similarity_pairs(t.embeddings, "vec_id", "label", "embedding", 0.3).select(*_long("label"), "a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH g AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS words FROM documents),
b AS (SELECT item_id AS id, array_to_string(string_split(text, ' ')[2 : n + 1], ' ') AS name, n FROM benchmark, range(1, 6) r(n)),
t AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region UNION ALL SELECT 10000 * n + id, name FROM b),
k AS (SELECT id, array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') AS gram, len(regexp_extract_all(lower(name), '[a-z0-9]+')) AS n FROM t)
SELECT DISTINCT doc_id, id AS name_id FROM g JOIN k ON contains(words, ' ' || gram || ' ') WHERE length(gram) >= 5 AND n BETWEEN 1 AND 5""")
def ngram_mentions(t: Tables) -> DataFrame:
    """Names of one to five words in documents: of nations, regions, and works by words of their beginnings."""
    works = [t.benchmark.select((10_000 * n + F.col("item_id")).alias("id"), F.array_join(F.slice(F.split("text", " "), 2, n), " ").alias("name")) for n in range(1, 6)]
    names = t.nation.select(*_long("n_nationkey"), F.col("n_name")).union(t.region.select((1000 + F.col("r_regionkey")).cast("long"), "r_name")).toDF("id", "name")
    for more in works:
        names = names.union(more)
    return search.ngram_mentions(t.documents.select("doc_id", "text"), "doc_id", F.col("text"), names)


@query("""SELECT doc_id, i::BIGINT AS chunk, md5(substr(text, i * 1800 + 1, 2000)) AS digest FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE ceil((length(text) - 2000) / 1800.0)::BIGINT + 1 END)) AS i FROM documents WHERE length(text) > 0)""")
def doc_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"), 2000, 200)).alias("chunk", "body")).select("doc_id", *_long("chunk"), F.md5("body").alias("digest"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"#]+)', 1)))::BIGINT AS links, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(text.links(F.col("html"))).cast("long").alias("links"), F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query()
def html_text(t: Tables) -> DataFrame:
    """Visible text of pages, by a parser."""
    from annalum.functions.python_only import html_text as visible

    return t.pages.select("page_id", F.length(visible("html")).alias("n"))


@query("""SELECT id, CASE WHEN contains(lower(category), 'brass') THEN 'metal' WHEN contains(lower(category), 'promo') OR contains(lower(category), 'eco') THEN 'trade' ELSE 'other' END AS class FROM event""")
def category_keywords(t: Tables) -> DataFrame:
    return t.event.select("id", text.classified(F.col("category"), {"metal": ("brass",), "trade": ("promo", "eco")}, "other").alias("class"))


@query("""SELECT n.id, n.name, trim(CASE WHEN starts_with(lower(name), 'king ') THEN substr(lower(name), 6) ELSE lower(name) END) AS plain FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'King ' || name ELSE name END AS name FROM location) n""")
def plain_names(t: Tables) -> DataFrame:
    named = t.location.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("King "), "name")).otherwise(F.col("name")).alias("name"))
    return named.select("id", "name", text.plain_name(F.col("name")).alias("plain"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages WHERE url ILIKE '%example%'""")
def page_hosts(t: Tables) -> DataFrame:
    return t.pages.filter(F.col("url").ilike("%example%")).select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


# ---- resolution

@query("""SELECT q.id, coalesce(n.m, a.m) AS match_id, CASE WHEN n.m IS NOT NULL THEN 'exact' WHEN a.m IS NOT NULL THEN 'alias' ELSE 'new' END AS stage
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN title || '?' WHEN id % 3 = 1 THEN category ELSE title END AS name FROM event) q
LEFT JOIN (SELECT lower(title) AS k, min(id) AS m FROM event WHERE id % 2 = 0 GROUP BY 1) n ON lower(q.name) = n.k LEFT JOIN (SELECT lower(category) AS k, min(id) AS m FROM event GROUP BY 1) a ON lower(q.name) = a.k""")
def staged_match(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("?"))).when(F.col("id") % 3 == 1, F.col("category")).otherwise(F.col("title"))
    return resolve.staged_match(t.event.select("id", name.alias("name")), t.event.filter("id % 2 = 0").select("id", F.col("title").alias("name")), t.event.select(F.col("id").alias("entity_id"), F.col("category").alias("alias"))).select("id", "match_id", "stage")


_TIER1_NAMES = ("upper(substr(title, 1, 1))", "CAST(id AS STRING)", "concat(CAST(id AS STRING), ' & 12')", "split_part(title, ' ', 1)", "concat(CAST(id % 30 AS STRING), 'th')", "'The'",
                "concat(split_part(title, ' ', 2), CASE WHEN id % 24 < 12 THEN ' VII' ELSE ' xiv' END)", "concat('St. ', title)", "concat('saint  ', title)", "title", "upper(title)", "'---'")


@query(f"""WITH n AS (SELECT id, importance AS m, CASE id % 12 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_TIER1_NAMES)).replace('STRING', 'VARCHAR')} END AS name FROM event),
r AS (SELECT *, lower(name) AS low FROM n),
f AS (SELECT *, length(name) < 2 OR length(name) > 100 OR regexp_full_match(low, '[a-z]|[a-z]{{2,4}}|[0-9]+( *[&,] *[0-9]+| *(st|nd|rd|th))?') OR low IN ('limited', 'company', 'works', 'march', 'brass', 'steel') OR NOT regexp_matches(low, '[a-z]') AS noise,
  regexp_full_match(low, '.{{3,}} +(vii|xiv)') AS royal, regexp_replace(regexp_replace(low, '^st[.] *', 'saint '), ' +', ' ', 'g') AS k FROM r),
g AS (SELECT k, count(*) AS c, arg_max(id, (m, -id)) AS best FROM f WHERE NOT noise AND NOT royal GROUP BY 1)
SELECT id, CASE WHEN noise THEN 'NOISE' WHEN royal THEN 'SEPARATE' WHEN c > 1 THEN 'MERGE' ELSE 'PASS' END AS rule, CASE WHEN NOT noise AND NOT royal AND c > 1 THEN best ELSE id END AS primary_id,
CASE WHEN royal AND NOT noise THEN regexp_replace(name, ' +[^ ]+$', '') END AS royal_base FROM f LEFT JOIN g USING (k)""")
def tier1_rules(t: Tables) -> DataFrame:
    """Names as recognisers find them: letters, numbers, addresses, abbreviations, ordinals, rulers, saints."""
    name = f"CASE id % 12 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_TIER1_NAMES))} END AS name"
    return resolve.tier1(t.event.selectExpr("id", name, "importance AS mentions")).select("id", "rule", "primary_id", "royal_base")


@query("""SELECT DISTINCT coalesce(m.new_id, e.entity_id) AS entity_id, source_id FROM mention e LEFT JOIN (SELECT id AS old_id, min(id) OVER (PARTITION BY title) AS new_id FROM event) m ON m.old_id = e.entity_id WHERE entity_type = 'event'""")
def merged_mentions(t: Tables) -> DataFrame:
    best = t.event.groupBy("title").agg(F.min("id").alias("new_id"))
    mapping = t.event.select(F.col("id").alias("old_id"), "title").join(best, "title").select("old_id", "new_id")
    return resolve.repointed(t.mentions("event").select("entity_id", "source_id"), mapping, "entity_id")


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN 'verified' WHEN length(name) < 3 THEN 'noise' WHEN s IS NOT NULL THEN 'sourced' ELSE 'unverified' END AS quality FROM person LEFT JOIN (SELECT DISTINCT entity_id AS s FROM mention WHERE entity_type = 'person' AND confidence >= 0.999) ON s = id""")
def quality_labels(t: Tables) -> DataFrame:
    sourced = t.mentions("person").filter("confidence >= 0.999").select(F.col("entity_id").alias("s")).distinct()
    return t.person.join(sourced, F.col("id") == F.col("s"), "left").select("id", resolve.quality_label(F.col("id") % 7 == 0, F.col("name"), F.col("s").isNotNull()).alias("quality"))


@query("""SELECT 'gazetteer' AS origin, id::BIGINT AS id, name, country, NULL::BIGINT AS year FROM location UNION ALL SELECT 'people', id::BIGINT, name, NULL, birth_year::BIGINT FROM person""")
def unify_sources(t: Tables) -> DataFrame:
    c = F.col
    return resolve.unify(gazetteer=(t.location, {"id": c("id").cast("long"), "name": c("name"), "country": c("country")}), people=(t.person, {"id": c("id").cast("long"), "name": c("name"), "year": c("birth_year").cast("long")}))


@query("""SELECT brand, arg_min(category, (-length(category), category)) AS category FROM event GROUP BY 1""")
def best_description(t: Tables) -> DataFrame:
    return resolve.longest_per_key(t.event, "brand", "category")


@query("""SELECT s.id, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0.95 WHEN b.v IS NOT NULL THEN 0.6 END::DOUBLE AS confidence FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN r_name END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) s
LEFT JOIN (SELECT n_name AS name, n_nationkey::BIGINT AS v FROM nation) a USING (name) LEFT JOIN (SELECT r_name AS region, 1000 + r_regionkey::BIGINT AS v FROM region) b USING (region)""")
def coordinate_cascade(t: Tables) -> DataFrame:
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).alias("place"), F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).alias("region"))
    by_name = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("value"))
    by_region = t.region.select(F.col("r_name").alias("name"), (1000 + F.col("r_regionkey")).cast("long").alias("value"))
    return joins.first_known(s, F.col("id"), [(by_name, F.col("place"), 0.95), (by_region, F.col("region"), 0.6)]).select("id", "value", "confidence")


@query("""SELECT kind, rank, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY starts_with(lower(name), 'a') DESC, name, id) AS rank FROM (SELECT 'event' AS kind, id::BIGINT AS id, title AS name FROM event UNION ALL SELECT 'location', id::BIGINT, name FROM location) WHERE contains(lower(name), 'a')) WHERE rank <= 5""")
def autocomplete_top5(t: Tables) -> DataFrame:
    return search.autocomplete("a", 5, event=t.event.select("id", F.col("title").alias("name")), location=t.location.select("id", "name")).select("kind", *_long("rank"), "id", "name")


@query("""SELECT p_partkey AS id, CASE WHEN y LIKE '-%' THEN CAST(regexp_extract(y, '^([+-]?[0-9]{1,6})', 1) AS BIGINT) ELSE CAST(regexp_extract(y, '^([0-9]{1,6})', 1) AS BIGINT) END AS year FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '-0' || (100 + p_size)::VARCHAR || '-01-01' ELSE (1000 + p_size)::VARCHAR END AS y FROM part)""")
def parsed_years(t: Tables) -> DataFrame:
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-0"), (100 + F.col("p_size")).cast("string"), F.lit("-01-01"))).otherwise((1000 + F.col("p_size")).cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), years.parsed(shown).cast("long").alias("year"))


@query()
def fuzzy_reconcile(t: Tables) -> DataFrame:
    named = t.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))
    known = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_size").alias("year")).select("id", F.col("p_name").alias("title"), "year")
    return resolve.fuzzy_reconcile(named, known)


@query("""SELECT type, status, n, rank FROM (SELECT type, status, count(*) AS n, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, status) AS rank FROM source GROUP BY 1, 2) WHERE rank <= 2""")
def top_per_group(t: Tables) -> DataFrame:
    return top_n(t.source.groupBy("type", "status").agg(F.count("*").alias("n")), ["type"], [F.desc("n"), F.asc("status")], 2).select("type", "status", "n", *_long("rank"))

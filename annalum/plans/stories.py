"""Stories, questions, answers, pages by kind, years in texts, confidence of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.functions import text, wiki, years
from annalum.operators import graph, pairs, questions, resolve, search, stories
from annalum.plans.catalog import ORACLE_SQL, query
from annalum.plans.complete import _OTHER, _YEAR, _candidates
from annalum.plans.knowledge import _LOC_EDGES, _near_chain
from annalum.plans.more import page_link_edges
from annalum.plans.queries import _long
from annalum.schema import Tables

_STORY = "event_id::BIGINT AS event_id, segment::BIGINT AS segment"


def _story(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *_long("event_id", "segment"), "narrative", "connection")


# ---- stories

@query(f"""WITH link AS (SELECT DISTINCT p.entity_id AS person_id, e.entity_id AS event_id FROM mention p JOIN mention e ON p.source_id = e.source_id AND p.chunk_index = e.chunk_index AND p.entity_type = 'person' AND e.entity_type = 'event'),
d AS (SELECT person_id, e.id AS event_id, title, date_start, 'linked' AS origin, row_number() OVER (PARTITION BY person_id ORDER BY date_start, e.id) AS segment FROM link JOIN event e ON e.id = event_id),
f AS (SELECT p.id, e.id, e.title, e.date_start, 'lifetime', row_number() OVER (PARTITION BY p.id ORDER BY importance DESC, date_start, e.id) FROM person p JOIN event e ON date_start BETWEEN birth_year - 20 AND coalesce(death_year, birth_year + 80) + 10
  WHERE p.id NOT IN (SELECT person_id FROM d)), a AS (SELECT * FROM d UNION ALL SELECT * FROM f)
SELECT person_id::BIGINT AS person_id, origin, {_STORY}, 'In ' || {_YEAR} || ', ' || name || ' was involved in ' || title || '.' AS narrative, CASE WHEN segment > 1 THEN 'follows' END AS connection
FROM a JOIN person p ON p.id = person_id WHERE segment <= 10""")
def person_stories(t: Tables) -> DataFrame:
    """Every person's story from the events that share a chunk of a source with them, else from the person's time."""
    mentioned = lambda kind: t.mentions(kind).select("source_id", "chunk_index", F.col("entity_id").alias(f"{kind}_id")).distinct()
    links = pairs.between(mentioned("person"), mentioned("event"), ["source_id", "chunk_index"], ["person_id"], ["event_id"])
    found = stories.person_segments(t.person, t.event, links)
    named = found.join(t.person.select(F.col("id").alias("person_id"), "name"), "person_id")
    return _story(stories.told("person", named, "name"), *_long("person_id"), "origin")


@query(f"""SELECT location_id::BIGINT AS location_id, {_STORY}, 'In ' || {_YEAR} || ', ' || title || ' took place at ' || name || '.' AS narrative, CASE WHEN segment > 1 THEN 'follows' END AS connection
FROM (SELECT location_id, id AS event_id, title, date_start, row_number() OVER (PARTITION BY location_id ORDER BY date_start, id) AS segment FROM event WHERE location_id IS NOT NULL AND date_start BETWEEN -1000 AND 1000) e
JOIN location l ON l.id = location_id WHERE segment <= 10""")
def place_stories(t: Tables) -> DataFrame:
    found = stories.place_segments(t.event, -1000, 1000)
    named = found.join(t.location.select(F.col("id").alias("location_id"), "name"), "location_id")
    return _story(stories.told("place", named, "name"), *_long("location_id"))


_ERAS = [("Classical", -500, -323), ("Hellenistic", -323, -31), ("Roman", -31, 476), ("Medieval", 476, 1453), ("Modern", 1453, None)]


@query(f"""WITH p(era, low, high) AS (VALUES {', '.join(f"('{n}', {a}, {2025 if b is None else b})" for n, a, b in _ERAS)})
SELECT era, {_STORY}, 'During the ' || era || ', ' || title || ' occurred in ' || {_YEAR} || '.' AS narrative, CASE WHEN segment > 1 THEN 'parallel' END AS connection
FROM (SELECT era, id AS event_id, title, date_start, row_number() OVER (PARTITION BY era ORDER BY importance DESC, date_start, id) AS segment FROM p JOIN event ON date_start BETWEEN low AND high) WHERE segment <= 10""")
def era_stories(t: Tables) -> DataFrame:
    return _story(stories.told("era", stories.era_segments(t.event, _ERAS), "era"), "era")


# ---- questions and answers

_FORMS = ("Compare {} with 476 CE", "Why did {} happen?", "Timeline of {} around 490 BCE", "Where is {}?", "Who made {} in the 5th century?", "Explain {}", "What is the relationship between {} and Rome?", "{}")
_PLANS = (  # intent, format, first and last year, of each form
    ("comparison", "comparison_table", 426, 526), ("causation", "flow_chart", None, None), ("timeline", "timeline_list", -540, -440), ("map_query", "map_markers", None, None),
    ("person_info", "cards", 400, 499), ("deep_dive", "narrative", None, None), ("connection", "flow_chart", None, None), ("overview", "narrative", None, None))


def _by_form(i: int) -> str:
    return " ".join(f"WHEN {k} THEN {'NULL' if p[i] is None else repr(p[i])}" for k, p in enumerate(_PLANS))


@query(f"""SELECT id, CASE id % 8 {_by_form(0)} END AS intent, CASE id % 8 {_by_form(1)} END AS format, CASE id % 8 {_by_form(2)} END::BIGINT AS year_from, CASE id % 8 {_by_form(3)} END::BIGINT AS year_to,
CASE WHEN id % 8 = 0 THEN 2 ELSE 1 END::BIGINT AS searches, CASE WHEN id % 8 = 0 THEN 10 ELSE 20 END::BIGINT AS per_search FROM event""")
def question_plans(t: Tables) -> DataFrame:
    """A question about every event, in eight forms."""
    asked = F.element_at(F.array(*[stories.filled(f.replace("{}", "{title}"), title=F.col("title")) for f in _FORMS]), (F.col("id") % 8 + 1).cast("int"))
    return questions.plans(t.event.select("id", asked.alias("question")))


@query(f"""WITH e AS (SELECT location_id, id, title, date_start, category FROM event WHERE location_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY date_start, id) = 1),
p AS (SELECT nation_id, name, birth_year, death_year FROM person QUALIFY row_number() OVER (PARTITION BY nation_id ORDER BY id) = 1),
a AS (SELECT l.id, l.name AS place, title, date_start, category, p.name, abs(birth_year)::VARCHAR AS b, abs(death_year)::VARCHAR AS d, CASE WHEN birth_year < 0 THEN 'BCE' ELSE 'CE' END AS be, CASE WHEN death_year < 0 THEN 'BCE' ELSE 'CE' END AS de, death_year
  FROM location l LEFT JOIN e ON e.location_id = l.id LEFT JOIN p ON p.nation_id = l.id)
SELECT id::BIGINT AS id, CASE WHEN title IS NULL AND name IS NULL THEN 'I don''t have specific information about ''' || place || ''' in my database. Please try a different query.' ELSE
 coalesce('Regarding events around ' || {_YEAR} || ':', '') || coalesce(E'\\n\\n**' || title || '** (' || {_YEAR} || E')\\n' || substr(category, 1, 500), '')
 || coalesce(E'\\n\\n**' || name || '** (' || CASE WHEN death_year IS NULL THEN b || ' ' || be || ' - ?' WHEN be = de THEN b || '-' || d || ' ' || be ELSE b || ' ' || be || ' - ' || d || ' ' || de END || ')', '') END AS answer FROM a""")
def fallback_answers(t: Tables) -> DataFrame:
    """What is said of each place without a model: its first event and its nation's first person."""
    event = t.event.filter("location_id is not null").groupBy(F.col("location_id").alias("id")).agg(F.min_by(F.struct("title", "date_start", "category"), F.struct("date_start", "id")).alias("e"))
    person = t.person.groupBy(F.col("nation_id").alias("id")).agg(F.min_by(F.struct("name", "birth_year", "death_year"), "id").alias("p"))
    both = t.location.select("id", F.col("name").alias("place")).join(event, "id", "left").join(person, "id", "left")
    said = stories.answer(
        F.col("place"), F.col("e.date_start"), F.col("e.title"), years.display(F.col("e.date_start"), F.lit("year")), F.col("e.category"),
        F.col("p.name"), years.lifespan(F.col("p.birth_year"), F.col("p.death_year")), F.lit(None).cast("string"))
    return both.select(*_long("id"), said.alias("answer"))


# ---- pages and texts

_PAGE_KINDS = (  # what is added to a page, and the kind that it then has
    ("<th>personal details</th><th>>Born<</th>", "person"), ("<table class=\"Infobox Monarch\">", "person"), ("<table class=\"infobox rail accident\">", "event"),
    ("<b>Belligerents</b> <b>Casualties</b>", "event"), ("<i>Coordinates</i> <i>Population</i>", "location"), ("", None))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'person' WHEN 2 THEN 'event' WHEN 3 THEN 'event' WHEN 4 THEN 'location' END AS kind, CASE WHEN page_id % 6 < 4 THEN 'Q' || (page_id + 1) END AS knowledge_key,
'https://example.org/' || page_id AS canonical, ['Page ' || page_id, 'Rome'] AS articles FROM pages""")
def page_facts(t: Tables) -> DataFrame:
    """Kind, key, address and articles of every page. The tables' pages hold none of these, so marks are put before them."""
    mark = F.element_at(F.array(*[F.lit(m) for m, _ in _PAGE_KINDS]), (F.col("page_id") % 6 + 1).cast("int"))
    key = F.when(F.col("page_id") % 6 < 4, F.concat(F.lit('<a href="https://www.wikidata.org/wiki/Q'), F.col("page_id") + 1, F.lit('">'))).otherwise(F.lit(""))
    head = F.concat(F.lit('<link rel="canonical" href="https://example.org/'), "page_id", F.lit('"><a href="/wiki/Page_'), "page_id", F.lit('"><a href="./Rome"><a href="/wiki/File:Map.png"><a href="/wiki/Rome">'))
    html = F.concat(head, key, mark, "html")
    return t.pages.select("page_id", html.alias("html")).select(
        "page_id", wiki.page_kind(F.col("html"), text.title(F.col("html"))).alias("kind"), wiki.knowledge_key(F.col("html")).alias("knowledge_key"),
        wiki.canonical_url(F.col("html")).alias("canonical"), wiki.article_links(F.col("html")).alias("articles"))


@query("""SELECT id::BIGINT AS id, (CASE id % 5 WHEN 2 THEN 476 WHEN 3 THEN -abs(birth_year) WHEN 4 THEN abs(birth_year) // 100 + 1 END)::BIGINT AS year, CASE id % 5 WHEN 2 THEN 'AD' WHEN 3 THEN 'BC' WHEN 4 THEN 'century' END AS mark,
(CASE WHEN id % 5 = 2 THEN 1950 WHEN id % 5 = 3 THEN -abs(birth_year) WHEN id % 5 < 2 THEN abs(birth_year) END)::BIGINT AS birth, (CASE WHEN id % 5 = 3 THEN -abs(birth_year) - 1 WHEN id % 5 < 2 THEN abs(birth_year) + 1 END)::BIGINT AS death FROM person""")
def text_years(t: Tables) -> DataFrame:
    """Years and lifespans found in sentences of five forms."""
    b, d = F.abs("birth_year").cast("string"), (F.abs("birth_year") + 1).cast("string")
    forms = [F.concat(F.lit("A ("), b, F.lit("–"), d, F.lit(") ruled.")), F.concat(F.lit("A (c. "), b, F.lit(" - "), d, F.lit(") ruled.")), F.lit("A (born 1950) wrote of 476 AD."),
             F.concat(F.lit("A ("), b, F.lit(" BC – "), d, F.lit(" BC) ruled.")), F.concat(F.lit("A of the "), (F.floor(F.abs("birth_year") / 100) + 1).cast("string"), F.lit("th century."))]
    said = t.person.select("id", F.element_at(F.array(*forms), (F.col("id") % 5 + 1).cast("int")).alias("s"))
    (year, mark), (birth, death) = years.in_text(F.col("s")), years.lifespan_in_text(F.col("s"))
    return said.select("id", year.alias("year"), mark.alias("mark"), birth.alias("birth"), death.alias("death")).select(*_long("id", "year", "birth", "death"), "mark")


@query("SELECT id::BIGINT AS id, name AS base FROM person")
def base_names(t: Tables) -> DataFrame:
    """Names without the ordinals and bynames that are put after them here."""
    ends = F.array(*[F.lit(e) for e in ("", " IV", " x", " 3rd", " 12", " the Younger", " the Great III")])
    name = F.concat("name", F.element_at(ends, (F.col("id") % 7 + 1).cast("int")))
    return t.person.select(*_long("id"), text.base_name(name).alias("base"))


# ---- candidates

@query(f"""WITH c AS (SELECT id, CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE 'fuzzy' END AS kind, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.75 END::DOUBLE AS n,
  CASE WHEN death_year IS NULL OR other_death IS NULL THEN NULL WHEN abs(birth_year - other_birth) <= 2 THEN 1.0 WHEN abs(birth_year - other_birth) <= 4 THEN 0.6 WHEN abs(birth_year - other_birth) <= 6 THEN 0.3 ELSE 0.0 END AS l FROM ({_OTHER})),
r AS (SELECT id, CASE WHEN l IS NULL THEN n WHEN l = 0 THEN 0 WHEN l <= 0.3 THEN n * 0.4 WHEN l < 0.8 THEN n * 0.9 WHEN kind = 'exact' THEN 1 WHEN kind = 'alias' THEN 0.98 ELSE least(n + 0.15, 0.95) END::DOUBLE AS s,
  kind || CASE WHEN l IS NULL THEN '_no_lifespan_data' WHEN l = 0 THEN '_but_lifespan_mismatch' WHEN l <= 0.3 THEN '_lifespan_suspicious' WHEN l < 0.8 THEN '_lifespan_partial' WHEN kind = 'fuzzy' THEN '_lifespan_boosted' ELSE '_lifespan_confirmed' END AS reason FROM c)
SELECT id::BIGINT AS id, round(s, 6) AS confidence, reason, CASE WHEN s >= 0.95 THEN 'auto' WHEN s >= 0.6 THEN 'review' WHEN s >= 0.3 THEN 'low' ELSE 'none' END AS action FROM r""")
def candidate_confidence(t: Tables) -> DataFrame:
    """Candidates of three kinds of names, weighed with the years that another source gives."""
    gap = F.abs(F.col("birth_year") - F.col("other_birth"))
    closeness = F.when(gap <= 2, 1.0).when(gap <= 4, 0.6).when(gap <= 6, 0.3).otherwise(0.0)
    lifespan = F.when(F.col("death_year").isNotNull() & F.col("other_death").isNotNull(), closeness)
    nth = F.col("id") % 3
    kind, name = F.when(nth == 0, "exact").when(nth == 1, "alias").otherwise("fuzzy"), F.when(nth == 0, 1.0).when(nth == 1, 0.95).otherwise(0.75)
    judged = _candidates(t).select("id", kind.alias("kind"), name.alias("name_score"), lifespan.alias("lifespan"))
    confidence, reason, action = resolve.match_confidence(F.col("name_score"), F.col("kind"), F.col("lifespan"))
    return judged.select(*_long("id"), F.round(confidence, 6).alias("confidence"), reason.alias("reason"), action.alias("action"))


@query()
def reconcile_candidates(t: Tables) -> DataFrame:
    """The three best known titles for each event."""
    events = t.event.select("id", "title", F.col("date_start").alias("year"))
    known = t.event.groupBy("title").agg(F.min("id").alias("id"), F.min("date_start").alias("year"))
    return resolve.reconcile_top(events, known).select("a_id", "b_id", "score", *_long("rank"))


@query()
def absorbed_vectors(t: Tables) -> DataFrame:
    """Similar vectors of one label, taken in by the first in the order of ids."""
    return graph.absorbed(search.similarity_pairs(t.embeddings, "vec_id", "label", "embedding", 0.3))


# ---- walks and links

def _walk_sql(step: str, limit: int) -> str:
    return "WITH RECURSIVE " + _LOC_EDGES.format(gap=400) + f""",
w AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT {step} AND depth < 5) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1 ORDER BY depth, node LIMIT {limit}"""


@query(_walk_sql("g.b_id, depth + 1 FROM w JOIN g ON g.a_id = w.node", 4))
def bfs_forward(t: Tables) -> DataFrame:
    """The first four nodes reached along edges."""
    return graph.bfs(_near_chain(t, 400), 7, 5, way="out", limit=4)


@query(_walk_sql("g.a_id, depth + 1 FROM w JOIN g ON g.b_id = w.node", 100))
def bfs_backward(t: Tables) -> DataFrame:
    return graph.bfs(_near_chain(t, 400), 7, 5, way="in", limit=100)


@query(f"""WITH l AS (SELECT id AS a, target_id AS b FROM ({ORACLE_SQL['page_link_edges']}) WHERE id <> target_id)
SELECT DISTINCT a_id, b_id, 2.0::DOUBLE AS strength, 0.5::DOUBLE AS confidence FROM (SELECT a AS a_id, b AS b_id FROM l UNION ALL SELECT b, a FROM l)""")
def two_way_page_links(t: Tables) -> DataFrame:
    return graph.two_ways(page_link_edges(t).select(F.col("id").alias("a_id"), F.col("target_id").alias("b_id")))

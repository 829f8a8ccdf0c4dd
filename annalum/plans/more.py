"""Further queries of the knowledge model: browsing, evidence, classification, imports, detail panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.functions import geo, scores, text, years
from annalum.operators import filters, graph, joins, mentions, pairs, resolve, search, windows
from annalum.plans.catalog import query
from annalum.plans.queries import _long
from annalum.schema import Tables


# ---- joins and blocks

@query("""SELECT p.id, l.id AS location_id FROM (SELECT id, split_part(CASE WHEN id % 2 = 0 THEN name || ' of NATION_' || (id % 25)::VARCHAR ELSE name END, ' of ', 2) AS place FROM person) p JOIN location l ON p.place <> '' AND contains(lower(l.name), lower(p.place))""")
def people_by_place_name(t: Tables) -> DataFrame:
    """The place after ' of ', found in names of places as a part of them. Names without it match none. All that people
    are of is one automaton, which reads every place's name once."""
    shown = F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" of NATION_"), (F.col("id") % 25).cast("string"))).otherwise(F.col("name"))
    named = t.person.select("id", F.lower(F.split_part(shown, F.lit(" of "), F.lit(2))).alias("place")).filter("place <> ''")
    places = t.location.select(F.col("id").alias("location_id"), F.col("name").alias("body"))
    met = mentions.name_counts(places, ["location_id"], "body", named.select(F.col("place").alias("name")))
    return named.join(met, F.col("place") == F.col("name")).select("id", "location_id")


@query("SELECT a.id AS a_id, b.id AS b_id FROM location a JOIN location b ON a.id < b.id AND substr(lower(a.name), 1, 3) = substr(lower(b.name), 1, 3)")
def prefix_blocks(t: Tables) -> DataFrame:
    key = lambda: F.array(F.substring(F.lower("name"), 1, 3))
    return joins.blocked_pairs(t.location, t.location, key(), key()).filter("a_id < b_id")


@query("""SELECT a.id AS a_id, min(b.id) AS b_id FROM event a JOIN event b ON a.id < b.id AND regexp_replace(lower(a.title), '[^a-z0-9]+', ' ', 'g') = regexp_replace(lower(b.title), '[^a-z0-9]+', ' ', 'g') AND a.date_start - ((a.date_start % 50) + 50) % 50 = b.date_start - ((b.date_start % 50) + 50) % 50 GROUP BY 1""")
def exact_title_year(t: Tables) -> DataFrame:
    e = t.event.select("id", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("k"), years.bucket(F.col("date_start"), 50).alias("y"))
    w = W.partitionBy("k", "y").orderBy("id")
    return e.select(F.col("id").alias("a_id"), F.lead("id").over(w).alias("b_id")).filter("b_id is not null")


@query("SELECT source_id, chunk_index::BIGINT AS chunk, source_id::VARCHAR || ':' || (row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, entity_id, round(confidence, 6)))::VARCHAR || '/' || (count(*) OVER (PARTITION BY source_id))::VARCHAR AS reference FROM mention WHERE entity_type = 'event'")
def chunk_references(t: Tables) -> DataFrame:
    w = W.partitionBy("source_id")
    nth = F.row_number().over(w.orderBy("chunk_index", "entity_id", F.round("confidence", 6)))
    return t.mentions("event").select("source_id", F.col("chunk_index").cast("long").alias("chunk"), F.concat_ws("", F.col("source_id").cast("string"), F.lit(":"), nth.cast("string"), F.lit("/"), F.count("*").over(w).cast("string")).alias("reference"))


@query("""WITH o AS (SELECT DISTINCT source_id, chunk_index, entity_id FROM mention WHERE entity_type = 'person')
SELECT a.entity_id AS a_id, b.entity_id AS b_id, count(*) AS together, least(2 * count(*), 20)::BIGINT AS boost FROM o a JOIN o b USING (source_id, chunk_index) WHERE a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def chunk_co_occurrence(t: Tables) -> DataFrame:
    """Pairs within one chunk of a source, seen at least twice."""
    own = t.mentions("person").select("source_id", "chunk_index", "entity_id").distinct()
    pairs = own.withColumnRenamed("entity_id", "a_id").join(own.withColumnRenamed("entity_id", "b_id"), ["source_id", "chunk_index"]).filter("a_id < b_id")
    n = pairs.groupBy("a_id", "b_id").agg(F.count("*").alias("together")).filter("together >= 2")
    return n.withColumn("boost", F.least(F.col("together") * 2, F.lit(20)).cast("long"))


@query("""WITH s AS (SELECT entity_id, count(DISTINCT source_id) AS sources, list_sort(list(DISTINCT source_id))[1:50] AS first_sources FROM mention WHERE entity_type = 'person' GROUP BY 1) SELECT entity_id AS person_id, sources, len(first_sources)::BIGINT AS linked, first_sources[1] AS first_source FROM s""")
def person_sources(t: Tables) -> DataFrame:
    """The first 50 sources of each person."""
    own = t.mentions("person").select(F.col("entity_id").alias("person_id"), "source_id").distinct()
    n = own.groupBy("person_id").agg(F.count("*").alias("sources"))
    linked = windows.top_n(own, ["person_id"], [F.asc("source_id")], 50).groupBy("person_id").agg(F.count("*").alias("linked"), F.min("source_id").alias("first_source"))
    return n.join(linked, "person_id").select("person_id", "sources", "linked", "first_source")


# ---- graphs and evidence

def _evidence(t: Tables, some: DataFrame) -> DataFrame:
    pairs = joins.co_mentions(some, t.mentions("event")).select(F.col("a_id").alias("person_id"), F.col("b_id").alias("event_id"))
    lives = t.person.select(F.col("id").alias("person_id"), (F.col("birth_year") - 20).alias("low"), (F.coalesce("death_year", F.col("birth_year") + 80) + 30).alias("high"))
    met = pairs.join(lives, "person_id").join(t.event.select(F.col("id").alias("event_id"), "date_start"), "event_id")
    return met.select("person_id", "event_id", F.when(F.col("date_start").between(F.col("low"), F.col("high")), "in_period").otherwise("other").alias("evidence"))


@query("""WITH m AS (SELECT DISTINCT p.entity_id AS person_id, e.entity_id AS event_id FROM mention p JOIN mention e ON p.source_id = e.source_id AND p.entity_type = 'person' AND e.entity_type = 'event')
SELECT person_id, event_id, CASE WHEN date_start BETWEEN birth_year - 20 AND coalesce(death_year, birth_year + 80) + 30 THEN 'in_period' ELSE 'other' END AS evidence FROM m JOIN person p ON p.id = person_id JOIN event e ON e.id = event_id""")
def person_evidence(t: Tables) -> DataFrame:
    """Events that share a source with a person, in the person's period or not."""
    return _evidence(t, t.mentions("person"))


@query("SELECT p.entity_id AS person_id, count(DISTINCT e.entity_id) AS events FROM mention p JOIN mention e ON p.source_id = e.source_id AND p.entity_type = 'person' AND e.entity_type = 'event' GROUP BY 1")
def story_availability(t: Tables) -> DataFrame:
    return joins.co_mentions(t.mentions("person"), t.mentions("event")).groupBy(F.col("a_id").alias("person_id")).agg(F.count("*").alias("events"))


@query("""WITH x AS (SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"#]+)', 1))) AS target FROM pages), n AS (SELECT page_id, '/' || lower(split_part(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), ' ', 1)) AS u FROM pages)
SELECT x.id, x.target, 'event' AS kind, max(n.page_id) AS target_id FROM x JOIN n ON lower(x.target) = n.u GROUP BY 1, 2""")
def page_link_edges(t: Tables) -> DataFrame:
    """Links of pages to pages whose title begins with the word linked."""
    pages = t.pages.select(F.col("page_id").alias("id"), text.links(F.col("html")).alias("links"))
    none = t.pages.select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("name")).filter("name is not null")
    named = t.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("/"), F.split_part(text.title(F.col("html")), F.lit(" "), F.lit(1))).alias("name"))
    return graph.link_edges(pages, none, named, none)


@query("""WITH s AS (SELECT location_id, id AS a_id, lead(id) OVER (PARTITION BY location_id ORDER BY date_start, id) AS b_id FROM event WHERE location_id IS NOT NULL) SELECT a_id, b_id FROM s WHERE b_id IS NOT NULL AND a_id % 7 <> 0 AND b_id % 7 <> 0""")
def false_positive_cleanup(t: Tables) -> DataFrame:
    return graph.edges_without(graph.location_chain_edges(t.event).select("a_id", "b_id"), t.event.filter("id % 7 = 0").select("id"))


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.38),
w AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT p.b, root FROM w JOIN p ON p.a = w.node) SELECT node, min(root) AS component FROM w GROUP BY 1""")
def vector_clusters(t: Tables) -> DataFrame:
    """Components of similar vectors within a label."""
    return graph.components(search.similarity_pairs(t.embeddings, "vec_id", "label", "embedding", 0.38).select("a_id", "b_id"))


def _strength(t: Tables, mentions: DataFrame) -> DataFrame:
    """From shared sources, places and years of life, never from an earlier strength."""
    met = joins.co_mention_pairs(mentions)
    side = lambda p: t.person.select(F.col("id").alias(f"{p}_id"), F.col("nation_id").alias(f"{p}_place"), F.col("birth_year").alias(f"{p}_birth"), F.col("death_year").alias(f"{p}_death"))
    shared = (F.col("a_place") == F.col("b_place")).cast("int")
    life, _ = scores.lifetime_overlap(F.col("a_birth"), F.col("a_death"), F.col("b_birth"), F.col("b_death"))
    strength = F.greatest(scores.source_factor(F.col("sources")) + 2.0 * shared + life, F.lit(0.1))
    return met.join(side("a"), "a_id").join(side("b"), "b_id").select("a_id", "b_id", F.round(strength, 6).alias("strength"))


@query("""WITH o AS (SELECT DISTINCT entity_id, source_id FROM mention WHERE entity_type = 'person'), c AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, count(*) AS sources FROM o a JOIN o b ON a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY ALL),
x AS (SELECT c.*, pa.nation_id = pb.nation_id AS same, greatest(pa.birth_year, pb.birth_year) AS low, least(coalesce(pa.death_year, pa.birth_year + 70), coalesce(pb.death_year, pb.birth_year + 70)) AS high FROM c JOIN person pa ON pa.id = a_id JOIN person pb ON pb.id = b_id)
SELECT a_id, b_id, round(greatest(sources * power(1 + ln(sources::DOUBLE), 1.5) + 2.0 * same::INT + CASE WHEN high - low >= 20 THEN 10 WHEN high - low >= 10 THEN 7 WHEN high >= low THEN 5 WHEN low - high <= 50 THEN 2 WHEN low - high <= 100 THEN 0 ELSE -5 END, 0.1), 6)::DOUBLE AS strength FROM x""")
def strength_recomputed(t: Tables) -> DataFrame:
    return _strength(t, t.mentions("person"))


# ---- browsing and observation

@query(f"""SELECT e.id, e.title, round(km, 6) AS km FROM event e JOIN (SELECT id, 2 * 6371.0 * asin(sqrt(least(power(sin((radians(12.0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(12.0)) * power(sin((radians(-30.0) - radians(longitude)) / 2), 2), 1.0))) AS km FROM location) l ON e.location_id = l.id WHERE km <= 5000 AND date_start <= 100 AND (date_end >= 100 OR date_end IS NULL)""")
def observe_place_and_time(t: Tables) -> DataFrame:
    return search.observe(t.event, t.location, 100, 12.0, -30.0, 5000.0).select("id", "title", F.round("km", 6).alias("km"))


@query("""SELECT id, name, n AS mentions FROM person JOIN (SELECT entity_id, count(*) AS n FROM mention WHERE entity_type = 'person' GROUP BY 1) ON entity_id = id ORDER BY n DESC, id LIMIT 20""")
def top_mentioned(t: Tables) -> DataFrame:
    top = t.mentions("person").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "id").limit(20)
    return t.person.select("id", "name").join(F.broadcast(top), "id")


@query("""SELECT id, title, abs(date_start - 120)::BIGINT AS apart FROM event WHERE date_start BETWEEN 70 AND 170 OR contains(lower(category), 'tin') ORDER BY apart, id LIMIT 40""")
def era_matching(t: Tables) -> DataFrame:
    keep = F.col("date_start").between(70, 170) | filters.contains("tin", F.col("category"))
    return t.event.filter(keep).select("id", "title", F.abs(F.col("date_start") - 120).cast("long").alias("apart")).orderBy("apart", "id").limit(40)


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name, count(n_nationkey) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def category_roots(t: Tables) -> DataFrame:
    children = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return t.region.join(children, "r_regionkey", "left").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.coalesce("n", F.lit(0)).alias("children"))


@query("""SELECT b.id AS id, a.id AS other_id, row_number() OVER (PARTITION BY b.id ORDER BY abs(a.date_start - b.date_start), a.id) AS rank FROM event b JOIN event a ON a.category = b.category AND a.brand = b.brand AND abs(a.date_start - b.date_start) > 100 QUALIFY rank <= 3""")
def same_category_far(t: Tables) -> DataFrame:
    """The three closest of a kind that are more than a century away."""
    return joins.nearest_years(t.event, ["category", "brand"], 3, 100).select("id", "other_id", *_long("rank"))


@query("""SELECT id, title FROM event WHERE category IS NOT NULL AND contains(lower(title), 'e') AND date_start BETWEEN -800 AND -300 AND trim(coalesce(CASE WHEN id % 3 = 0 THEN '' ELSE title END, category)) <> '' ORDER BY date_start, id LIMIT 100""")
def sidebar_filter(t: Tables) -> DataFrame:
    local = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("title"))
    keep = filters.every(F.col("category").isNotNull(), filters.contains("e", F.col("title")), filters.between(F.col("date_start"), -800, -300), F.trim(F.coalesce(local, "category")) != "")
    return t.event.filter(keep).orderBy("date_start", "id").limit(100).select("id", "title")


@query("""SELECT min(id) FILTER (date_start >= 0)::BIGINT AS first_dated, count(*) FILTER (k <= 5) AS located FROM (SELECT id, date_start, row_number() OVER (ORDER BY date_start, id) AS k FROM event WHERE location_id IS NOT NULL AND category LIKE '%A%')""")
def navigation(t: Tables) -> DataFrame:
    """Where to go from a result: its first dated row, and at most five with a place."""
    found = t.event.filter("location_id is not null and category like '%A%'")
    five = found.orderBy("date_start", "id").limit(5).agg(F.count("*").alias("located"))
    return found.filter("date_start >= 0").agg(F.min("id").alias("first_dated")).crossJoin(five)


@query("SELECT count(*) FILTER (location_id IS NULL) AS missing, count(*) FILTER (location_id IS NULL) * 100 AS tokens, round(count(*) FILTER (location_id IS NULL) * 100 * 0.02 / 1000000, 9)::DOUBLE AS dollars FROM event")
def embedding_cost(t: Tables) -> DataFrame:
    n = F.count_if(F.col("location_id").isNull())
    return t.event.agg(n.alias("missing"), (n * 100).alias("tokens"), F.round(n * 100 * 0.02 / 1000000, 9).alias("dollars"))


@query("""SELECT id, 'Title: ' || title || chr(10) || 'Year: ' || date_start::VARCHAR || CASE WHEN location_id IS NOT NULL THEN chr(10) || 'Location: ' || location_id::VARCHAR ELSE '' END || chr(10) || 'Description: ' || category AS body FROM event""")
def embedding_texts(t: Tables) -> DataFrame:
    return t.event.select("id", search.embedding_text(F.col("title"), F.col("date_start"), F.col("location_id"), F.col("category")).alias("body"))


# ---- classification, imports, quality

@query("""SELECT id, CASE WHEN importance >= 5 THEN 5 WHEN date_end - date_start > 30 THEN 4 ELSE 3 END::BIGINT AS weight, CASE WHEN title LIKE '%blue%' THEN 'birth' WHEN category LIKE '%BRASS%' THEN 'battle' WHEN importance >= 4 THEN 'major' ELSE 'political' END AS node FROM event""")
def node_types(t: Tables) -> DataFrame:
    weight = F.when(F.col("importance") >= 5, 5).when(F.col("date_end") - F.col("date_start") > 30, 4).otherwise(3)
    node = F.when(F.col("title").contains("blue"), "birth").when(F.col("category").contains("BRASS"), "battle").when(F.col("importance") >= 4, "major").otherwise("political")
    return t.event.select("id", weight.cast("long").alias("weight"), node.alias("node"))


@query("""SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 80000)), 'born') THEN 'person' WHEN contains(lower(substr(html, 1, 80000)), 'battle') THEN 'event' WHEN contains(lower(substr(html, 1, 80000)), '<h1') THEN 'titled' ELSE 'other' END AS kind FROM pages""")
def page_classes(t: Tables) -> DataFrame:
    """The class of a page by what its first 80,000 characters hold; the limit is the operator's own."""
    return t.pages.select("page_id", text.classified(F.substring("html", 1, 80000), {"person": ("born",), "event": ("battle",), "titled": ("<h1",)}, "other").alias("kind"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 90)::DOUBLE END AS latitude, CASE WHEN p_partkey % 2 = 0 THEN -(p_partkey % 180)::DOUBLE END AS longitude FROM part""")
def parsed_points(t: Tables) -> DataFrame:
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Point(-"), (F.col("p_partkey") % 180).cast("string"), F.lit(" "), (F.col("p_partkey") % 90).cast("string"), F.lit(")"))).otherwise(F.lit("none"))
    lat, lng = geo.wkt_point(shown)
    return t.part.select(F.col("p_partkey").alias("id"), lat.alias("latitude"), F.when(lng == 0, -lng).otherwise(lng).alias("longitude"))


@query("""SELECT id, (least(length(category) // 10, 50) + CASE WHEN id % 2 = 0 THEN 50 ELSE 0 END + importance * 10 + CASE WHEN location_id IS NOT NULL THEN 10 ELSE 0 END)::BIGINT AS quality FROM event""")
def record_quality(t: Tables) -> DataFrame:
    q = scores.record_quality(F.col("category"), F.col("id") % 2 == 0, F.lit(False), F.col("importance"), F.lit(0), F.col("location_id").isNotNull(), F.lit(False))
    return t.event.select("id", q.cast("long").alias("quality"))


@query("""SELECT b.brand AS key, arg_max(id, (CASE WHEN length(title) BETWEEN 10 AND 30 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(title, '^[a-z ]+$') THEN 5 ELSE 0 END, -id)) AS primary_id, count(*) AS members FROM event b GROUP BY 1 HAVING count(*) > 1""")
def primary_selection(t: Tables) -> DataFrame:
    """The row of each duplicate key with the best name."""
    score = F.when(F.length("title").between(10, 30), 5).otherwise(0) + F.when(F.col("title").rlike("^[a-z ]+$"), 5).otherwise(0)
    out = t.event.groupBy(F.col("brand").alias("key")).agg(F.max(F.struct(score.alias("s"), (-F.col("id")).alias("m"))).alias("best"), F.count("*").alias("members"))
    return out.filter("members > 1").select("key", (-F.col("best.m")).alias("primary_id"), "members")


@query("""SELECT id, CASE WHEN best > 0.85 AND second <= 0.8 THEN 'LINK' WHEN best > 0.6 THEN 'PENDING' ELSE 'CREATE' END AS decision FROM (SELECT p_partkey AS id, (p_partkey % 101) / 100.0::DOUBLE AS best, (p_partkey % 97) / 100.0::DOUBLE AS second FROM part)""")
def link_decisions(t: Tables) -> DataFrame:
    best, second = (F.col("p_partkey") % 101) / F.lit(100.0), (F.col("p_partkey") % 97) / F.lit(100.0)
    return t.part.select(F.col("p_partkey").alias("id"), resolve.decide(best, second, F.lit(False)).alias("decision"))


@query("""SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN lower(n_name) = r THEN 1.0 WHEN contains(lower(n_name), r) OR contains(r, lower(n_name)) THEN 0.8 ELSE 0.0 END::DOUBLE AS similarity FROM nation, (SELECT 'nation_1' AS r)""")
def token_similarity(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), text.token_overlap(F.lower("n_name"), F.lit("nation_1")).alias("similarity"))


@query("""SELECT entity_id AS id, count(*) AS mentions, greatest(1, least(5, count(*) // 2))::BIGINT AS importance FROM mention WHERE entity_type = 'event' GROUP BY 1 HAVING count(*) >= 3""")
def ner_import(t: Tables) -> DataFrame:
    n = t.mentions("event").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions")).filter("mentions >= 3")
    return n.withColumn("importance", F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("mentions") / 2))).cast("long"))


@query("""SELECT a.id AS id, coalesce(CASE WHEN a.id % 4 <> 0 THEN a.category END, b.category) AS category FROM event a LEFT JOIN (SELECT brand, min(category) AS category FROM event GROUP BY 1) b USING (brand)""")
def enrichment_filled(t: Tables) -> DataFrame:
    """Missing values filled from a table by key; known ones stay."""
    known = t.event.groupBy("brand").agg(F.min("category").alias("found"))
    return t.event.select("id", "brand", F.when(F.col("id") % 4 != 0, F.col("category")).alias("own")).join(known, "brand", "left").select("id", F.coalesce("own", "found").alias("category"))


@query("SELECT doc_id, len(list_distinct(list_filter(['worthless', 'idiot', 'copyright'], lambda k: contains(lower(coalesce(text, '')), k))))::BIGINT AS keywords FROM documents")
def keyword_books(t: Tables) -> DataFrame:
    """How many of a list of keywords a text holds; a text without any has 0."""
    listed = t.spark.createDataFrame([("copyright",), ("idiot",), ("worthless",)], "name string")
    own = t.documents.select("doc_id", "text")
    met = mentions.name_counts(own, ["doc_id"], "text", listed).groupBy("doc_id").agg(F.count("*").alias("k"))
    return own.select("doc_id").join(met, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(0)).alias("keywords"))


@query()
def sample_per_stratum(t: Tables) -> DataFrame:
    """Ten events of each weight, drawn by a seeded hash."""
    return windows.top_n(t.event, ["importance"], [F.xxhash64("id", F.lit(7)).asc(), F.asc("id")], 10).select("importance", "id")

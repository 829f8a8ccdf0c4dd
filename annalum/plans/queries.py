"""Queries of the knowledge model: filters, joins, aggregates, windows, sets, changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.functions import geo, scores, years
from annalum.operators import aggregates, filters, graph, joins, windows
from annalum.plans.catalog import query
from annalum.schema import Tables
from annalum.sources import sinks

_long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
_EDGE = "sources + 0.0"


# ---- filters and projections

@query("SELECT id, title, date_start::BIGINT AS date_start FROM event WHERE date_start BETWEEN -500 AND 500 AND importance >= 4 AND location_id IS NOT NULL ORDER BY date_start, id")
def filtered_events(t: Tables) -> DataFrame:
    keep = filters.every(filters.between(F.col("date_start"), -500, 500), F.col("importance") >= 4, F.col("location_id").isNotNull(), filters.equal(F.col("category"), None))
    return t.event.filter(keep).select("id", "title", *_long("date_start"))


@query("SELECT id, date_start::BIGINT AS date_start, date_end::BIGINT AS date_end FROM event WHERE date_end <= 0 OR (date_end IS NULL AND date_start <= 0)")
def ended_by_year(t: Tables) -> DataFrame:
    return t.event.filter(filters.ends_by(F.col("date_start"), F.col("date_end"), 0)).select("id", *_long("date_start", "date_end"))


@query("SELECT id, title FROM event WHERE date_start <= 120 AND (date_end >= 120 OR date_end IS NULL)")
def active_in_year(t: Tables) -> DataFrame:
    return t.event.filter(years.active(F.col("date_start"), F.col("date_end"), 120)).select("id", "title")


@query("SELECT id, name FROM person WHERE death_year >= -200 AND birth_year <= 300")
def lifespan_overlap(t: Tables) -> DataFrame:
    return t.person.filter(years.overlap(F.col("birth_year"), F.col("death_year"), -200, 300)).select("id", "name")


@query("SELECT id, name, (birth_year <= 10 AND coalesce(death_year, birth_year + 80) >= 10) AS alive FROM person")
def alive_in_year(t: Tables) -> DataFrame:
    return t.person.select("id", "name", years.alive(F.col("birth_year"), F.col("death_year"), 10).alias("alive"))


@query("SELECT e.id, e.title, l.latitude, l.longitude FROM event e JOIN location l ON e.location_id = l.id WHERE l.latitude BETWEEN -30 AND 45 AND l.longitude BETWEEN -100 AND 60 AND date_start BETWEEN -1000 AND 1000")
def bbox_markers(t: Tables) -> DataFrame:
    inside = t.location.filter(geo.in_box(F.col("latitude"), F.col("longitude"), (45, -100), (-30, 60)))
    events = t.event.filter(filters.between(F.col("date_start"), -1000, 1000)).select("id", "title", "location_id")
    return events.join(inside.select(F.col("id").alias("location_id"), "latitude", "longitude"), "location_id").select("id", "title", "latitude", "longitude")


@query("SELECT id, name FROM location WHERE latitude >= 10 AND latitude <> 0 AND longitude <> 0")
def one_sided_box(t: Tables) -> DataFrame:
    return t.location.filter(filters.every(F.col("latitude") >= 10, F.col("latitude") != 0, F.col("longitude") != 0)).select("id", "name")


@query("""SELECT id, name, round(km, 6) AS km FROM (SELECT id, name, 2 * 6371.0 * asin(sqrt(least(power(sin((radians(10.0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(10.0)) * power(sin((radians(20.0) - radians(longitude)) / 2), 2), 1.0))) AS km FROM location) WHERE km <= 4000""")
def radius_places(t: Tables) -> DataFrame:
    km = geo.haversine(F.col("latitude"), F.col("longitude"), 10.0, 20.0)
    return t.location.withColumn("km", km).filter("km <= 4000").select("id", "name", F.round("km", 6).alias("km"))


@query("SELECT a.id AS a_id, b.id AS b_id FROM location a JOIN location b ON a.id < b.id AND abs(a.latitude - b.latitude) < 15 AND abs(a.longitude - b.longitude) < 15")
def degree_box_pairs(t: Tables) -> DataFrame:
    """Places meet by cells of the box's size and their neighbours."""
    size = 15
    a = t.location.select(F.col("id").alias("a_id"), F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lng"))
    cells = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(c) / size) + d))
    a = a.withColumn("row", cells("a_lat")).withColumn("col", cells("a_lng"))
    b = t.location.select(F.col("id").alias("b_id"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lng"), F.floor(F.col("latitude") / size).alias("row"), F.floor(F.col("longitude") / size).alias("col"))
    return a.join(b, ["row", "col"]).filter((F.col("a_id") < F.col("b_id")) & geo.near_degrees(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"), size)).select("a_id", "b_id")


@query("SELECT id, title FROM event WHERE contains(lower(title), 'red') OR contains(lower(category), 'brass')")
def substring_events(t: Tables) -> DataFrame:
    return t.event.filter(filters.contains("Red", F.col("title"), F.col("category"))).unionByName(t.event.filter(filters.contains("brass", F.col("category")) & ~filters.contains("red", F.col("title"), F.col("category")))).select("id", "title")


@query("SELECT id, name FROM person WHERE regexp_matches(name, '^[A-Z].*[0-9]$') AND NOT starts_with(lower(name), 'mr. ')")
def named_people(t: Tables) -> DataFrame:
    return t.person.filter(F.col("name").rlike("^[A-Z].*[0-9]$") & filters.not_noise(F.col("name"))).select("id", "name")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AND event_type = 'purchase'")
def json_props_filter(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.filter((F.col("event_type") == "purchase") & (k >= 50)).select("event_id", "user_id", k.alias("k"))


@query("SELECT id, title, date_start::BIGINT AS date_start FROM event ORDER BY importance DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def explore_page(t: Tables) -> DataFrame:
    order = [*filters.sort_key("importance", {"importance": "importance", "date": "date_start"}, "date"), F.asc("id")]
    return filters.page(t.event, order, 50, 25).select("id", "title", *_long("date_start"))


@query("""SELECT * FROM (
 SELECT 'event' AS kind, e.id::BIGINT AS id, e.title AS name, l.latitude, l.longitude, '#6b7280' AS color FROM event e JOIN location l ON e.location_id = l.id WHERE date_start BETWEEN 0 AND 400
 UNION ALL SELECT 'location', id::BIGINT, name, latitude, longitude, '#14b8a6' FROM location) ORDER BY kind, id LIMIT 100""")
def markers_union(t: Tables) -> DataFrame:
    """Events and places as markers, one plan; events without a known category are grey."""
    events = t.event.filter(filters.between(F.col("date_start"), 0, 400)).join(t.location.select(F.col("id").alias("location_id"), "latitude", "longitude"), "location_id")
    a = events.select(F.lit("event").alias("kind"), F.col("id").cast("long").alias("id"), F.col("title").alias("name"), "latitude", "longitude", F.lit("#6b7280").alias("color"))
    b = t.location.select(F.lit("location").alias("kind"), F.col("id").cast("long").alias("id"), "name", "latitude", "longitude", F.lit("#14b8a6").alias("color"))
    return a.unionByName(b).orderBy("kind", "id").limit(100)


@query("SELECT id, title FROM event WHERE NOT (300 < date_start - 20) AND NOT (300 > coalesce(date_end, date_start) + 20) OR date_start IS NULL")
def visible_at_year(t: Tables) -> DataFrame:
    hidden = (F.lit(300) < F.col("date_start") - 20) | (F.lit(300) > F.coalesce("date_end", "date_start") + 20)
    return t.event.filter(F.col("date_start").isNull() | ~hidden).select("id", "title")


@query("""SELECT id, CASE WHEN date_start < 0 THEN 'BCE' ELSE 'CE' END AS era,
 CASE WHEN id % 3 = 0 THEN (abs(date_start) // 100 + 1)::VARCHAR || 'th century ' || CASE WHEN date_start < 0 THEN 'BCE' ELSE 'CE' END
      WHEN id % 3 = 1 THEN (abs(date_start) - abs(date_start) % 10)::VARCHAR || 's ' || CASE WHEN date_start < 0 THEN 'BCE' ELSE 'CE' END
      ELSE abs(date_start)::VARCHAR || ' ' || CASE WHEN date_start < 0 THEN 'BCE' ELSE 'CE' END END AS shown FROM event""")
def date_display(t: Tables) -> DataFrame:
    precision = F.when(F.col("id") % 3 == 0, "century").when(F.col("id") % 3 == 1, "decade").otherwise("year")
    return t.event.select("id", years.era(F.col("date_start")).alias("era"), years.display(F.col("date_start"), precision).alias("shown"))


@query("""SELECT id, CASE WHEN birth_year IS NULL AND death_year IS NULL THEN 'Unknown'
 WHEN death_year IS NOT NULL AND (birth_year < 0) = (death_year < 0) THEN abs(birth_year)::VARCHAR || '-' || abs(death_year)::VARCHAR || CASE WHEN birth_year < 0 THEN ' BCE' ELSE ' CE' END
 ELSE abs(birth_year)::VARCHAR || CASE WHEN birth_year < 0 THEN ' BCE' ELSE ' CE' END || ' - ' || CASE WHEN death_year IS NULL THEN '?' ELSE abs(death_year)::VARCHAR || CASE WHEN death_year < 0 THEN ' BCE' ELSE ' CE' END END END AS lifespan FROM person""")
def lifespan_display(t: Tables) -> DataFrame:
    return t.person.select("id", years.lifespan(F.col("birth_year"), F.col("death_year")).alias("lifespan"))


# ---- joins

@query("SELECT l.country, count(*) AS n, min(date_start)::BIGINT AS first_year, max(date_start)::BIGINT AS last_year FROM event e JOIN location l ON e.location_id = l.id GROUP BY 1")
def events_by_country(t: Tables) -> DataFrame:
    """Events are counted per place before they meet the places."""
    own = t.event.filter("location_id is not null").groupBy("location_id").agg(F.count("*").alias("n"), F.min("date_start").alias("a"), F.max("date_start").alias("b"))
    joined = own.join(t.location.select(F.col("id").alias("location_id"), "country"), "location_id")
    return joined.groupBy("country").agg(F.sum("n").alias("n"), F.min("a").cast("long").alias("first_year"), F.max("b").cast("long").alias("last_year"))


@query("SELECT m.entity_type, m.entity_id, coalesce(e.title, p.name) AS name, count(*) AS n FROM mention m LEFT JOIN event e ON m.entity_type = 'event' AND m.entity_id = e.id LEFT JOIN person p ON m.entity_type = 'person' AND m.entity_id = p.id GROUP BY ALL")
def polymorphic_mentions(t: Tables) -> DataFrame:
    counted = t.mention.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"))
    return joins.polymorphic(counted, event=t.event.select("id", F.col("title").alias("name")), person=t.person.select("id", "name")).select("entity_type", "entity_id", "name", "n")


@query("""WITH o AS (SELECT DISTINCT entity_id, source_id FROM mention WHERE entity_type = 'person')
SELECT a.entity_id AS a_id, b.entity_id AS b_id, count(*) AS sources FROM o a JOIN o b ON a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY ALL HAVING count(*) >= 2""")
def co_mention_persons(t: Tables) -> DataFrame:
    return joins.co_mention_pairs(t.mentions("person"), 2)


@query("""WITH p AS (SELECT DISTINCT entity_id, source_id FROM mention WHERE entity_type = 'person'), e AS (SELECT DISTINCT entity_id, source_id FROM mention WHERE entity_type = 'event')
SELECT p.entity_id AS a_id, e.entity_id AS b_id, count(*) AS sources FROM p JOIN e USING (source_id) GROUP BY ALL HAVING count(*) >= 2""")
def co_mention_person_event(t: Tables) -> DataFrame:
    return joins.co_mentions(t.mentions("person"), t.mentions("event")).filter("sources >= 2")


@query("SELECT id, title FROM event WHERE id NOT IN (SELECT entity_id FROM mention WHERE entity_type = 'event' AND confidence >= 0.995)")
def orphan_events_anti(t: Tables) -> DataFrame:
    sure = t.mentions("event").filter("confidence >= 0.995").select(F.col("entity_id").alias("id"))
    return t.event.join(sure, "id", "left_anti").select("id", "title")


@query("""SELECT id, title, date_start::BIGINT AS date_start FROM event WHERE (title, date_start - ((date_start % 500) + 500) % 500) IN (SELECT (title, date_start - ((date_start % 500) + 500) % 500) FROM event GROUP BY ALL HAVING count(*) > 1)""")
def duplicate_events_semi(t: Tables) -> DataFrame:
    e = t.event.withColumn("span", years.bucket(F.col("date_start"), 500))
    several = e.groupBy("title", "span").count().filter("count > 1")
    return e.join(several, ["title", "span"], "left_semi").select("id", "title", *_long("date_start"))


@query("""SELECT person_id, event_id, date_start, importance, rank FROM (
 SELECT p.id AS person_id, e.id AS event_id, date_start::BIGINT AS date_start, importance::BIGINT AS importance, row_number() OVER (PARTITION BY p.id ORDER BY importance DESC, date_start, e.id) AS rank
 FROM person p JOIN event e ON date_start BETWEEN birth_year AND coalesce(death_year, birth_year + 80) WHERE importance >= 4) WHERE rank <= 5""")
def lifetime_events_top5(t: Tables) -> DataFrame:
    return joins.in_lifetime(t.person, t.event.filter("importance >= 4"), 5).select("person_id", "event_id", *_long("date_start", "importance", "rank"))


_KM = "2 * 6371.0 * asin(sqrt(least(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin((radians({d}) - radians({b})) / 2), 2), 1.0)))"


@query(f"""WITH c AS (SELECT c_custkey AS id, CAST((c_custkey * 31) % 170 - 85 AS DOUBLE) AS latitude, CAST((c_custkey * 57) % 351 - 175 AS DOUBLE) AS longitude FROM customer),
m AS (SELECT c.id, l.id AS place_id, {_KM.format(a='c.latitude', b='c.longitude', c='l.latitude', d='l.longitude')} AS km FROM c, location l)
SELECT id, arg_min(place_id, (km, place_id)) AS place_id, round(min(km), 6) AS km FROM m WHERE km <= 1500 GROUP BY id""")
def nearest_location(t: Tables) -> DataFrame:
    points = t.customer.selectExpr("c_custkey AS id", "CAST((c_custkey * 31) % 170 - 85 AS DOUBLE) AS latitude", "CAST((c_custkey * 57) % 351 - 175 AS DOUBLE) AS longitude")
    return joins.nearest(points, t.location, 1500.0).select("id", "place_id", F.round("km", 6).alias("km"))


@query("""SELECT id, side, rank, other_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY abs(gap), other_id) AS rank FROM
 (SELECT a.id, b.id AS other_id, (b.date_start - a.date_start)::BIGINT AS gap, CASE WHEN b.date_start < a.date_start THEN 'before' ELSE 'after' END AS side
  FROM event a JOIN event b ON b.date_start <> a.date_start AND abs(b.date_start - a.date_start) <= 100)) WHERE rank <= 3""")
def nearest_before_after(t: Tables) -> DataFrame:
    return joins.neighbours_in_time(t.event, 3, 100).select("id", "side", *_long("rank", "other_id", "gap"))


@query("""SELECT a.id, min(b.id) AS same_cell_id FROM location a JOIN location b ON round(a.latitude / 20) = round(b.latitude / 20) AND round(a.longitude / 20) = round(b.longitude / 20) GROUP BY 1""")
def grid_cell_match(t: Tables) -> DataFrame:
    key = lambda c: F.round(F.col(c) / 20)
    cells = t.location.groupBy(key("latitude").alias("row"), key("longitude").alias("col")).agg(F.min("id").alias("same_cell_id"))
    return t.location.select("id", key("latitude").alias("row"), key("longitude").alias("col")).join(cells, ["row", "col"]).select("id", "same_cell_id")


@query("""SELECT a.a_id AS id, b.b_id AS other FROM (SELECT s_suppkey AS a_id, s_nationkey FROM supplier) a JOIN (SELECT s_suppkey AS b_id, s_nationkey FROM supplier) b USING (s_nationkey) WHERE a_id < b_id
 UNION SELECT b.b_id, a.a_id FROM (SELECT s_suppkey AS a_id, s_nationkey FROM supplier) a JOIN (SELECT s_suppkey AS b_id, s_nationkey FROM supplier) b USING (s_nationkey) WHERE a_id < b_id""")
def related_persons(t: Tables) -> DataFrame:
    return joins.same_group(t.person, "nation_id")


# ---- aggregates

@query("""SELECT count(*) AS events, count(DISTINCT e.location_id) AS locations, count(date_end) AS ended, round(count(location_id) * 100.0 / count(*), 1) AS located_percent, min(date_start)::BIGINT AS first_year, max(date_start)::BIGINT AS last_year, round(avg(importance), 6) AS importance FROM event e""")
def overview_counts(t: Tables) -> DataFrame:
    return t.event.agg(F.count("*").alias("events"), F.countDistinct("location_id").alias("locations"), F.count("date_end").alias("ended"), F.round(F.count("location_id") * 100.0 / F.count("*"), 1).cast("double").alias("located_percent"), F.min("date_start").cast("long").alias("first_year"), F.max("date_start").cast("long").alias("last_year"), F.round(F.avg("importance"), 6).alias("importance"))


_HIST = """SELECT y AS year_start, y + 99 AS year_end, n, CASE WHEN y < 0 THEN abs(y)::VARCHAR || '-' || abs(y + 99)::VARCHAR || ' BCE' ELSE y::VARCHAR || '-' || (y + 99)::VARCHAR || ' CE' END AS label
FROM (SELECT ({b})::BIGINT AS y, count(*) AS n FROM event WHERE date_start BETWEEN -2000 AND 1500 GROUP BY 1)"""


@query(_HIST.format(b="date_start - date_start % 100"))
def year_histogram_trunc(t: Tables) -> DataFrame:
    return aggregates.year_histogram(t.event, 100, -2000, 1500, "trunc").select(*_long("year_start", "year_end"), "n", "label")


@query(_HIST.format(b="date_start - ((date_start % 100) + 100) % 100"))
def year_histogram_floor(t: Tables) -> DataFrame:
    return aggregates.year_histogram(t.event, 100, -2000, 1500, "floor").select(*_long("year_start", "year_end"), "n", "label")


@query("""SELECT segment, n, round(n / (max(n) OVER ())::DOUBLE, 6) AS density FROM (SELECT floor((date_start + 3000) * 100 / 5000.0)::BIGINT AS segment, count(*) AS n FROM event WHERE date_start >= -3000 AND date_start < 2000 GROUP BY 1)""")
def timeline_density(t: Tables) -> DataFrame:
    return aggregates.timeline_density(t.event, -3000, 2000, 100).select(*_long("segment"), "n", F.round("density", 6).alias("density"))


@query("""SELECT (r + 0.5::DOUBLE) * 10 AS latitude, (c + 0.5::DOUBLE) * 10 AS longitude, n, first_year, last_year FROM (SELECT floor(latitude / 10) AS r, floor(longitude / 10) AS c, count(*) AS n, min(date_start)::BIGINT AS first_year, max(date_start)::BIGINT AS last_year FROM event e JOIN location l ON e.location_id = l.id GROUP BY 1, 2)""")
def geo_grid_clusters(t: Tables) -> DataFrame:
    return aggregates.grid_clusters(t.event, t.location, 10.0).select(F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "n", *_long("first_year", "last_year"))


@query("""SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(*) AS n, min(id)::BIGINT AS first_id FROM location GROUP BY floor(latitude / (375.0 / 111.0)), floor(longitude / (375.0 / 111.0))""")
def zoom_clusters(t: Tables) -> DataFrame:
    return aggregates.zoom_clusters(t.location, 2.5).select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "n", *_long("first_id"))


@query("""WITH g AS (SELECT l.country, count(*) AS n FROM event e JOIN location l ON e.location_id = l.id GROUP BY 1 ORDER BY n DESC, country LIMIT 3) SELECT country, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS percent FROM g""")
def geography_share(t: Tables) -> DataFrame:
    """Shares of the countries listed, not of all."""
    placed = t.event.select("location_id").join(t.location.select(F.col("id").alias("location_id"), "country"), "location_id")
    return aggregates.shares(placed, "country", 3).select("country", "n", F.col("percent").cast("double").alias("percent"))


@query("SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM event GROUP BY 1")
def category_share(t: Tables) -> DataFrame:
    return aggregates.shares(t.event, "category").select("category", "n", F.col("percent").cast("double").alias("percent"))


@query("SELECT coalesce(CASE WHEN location_id IS NOT NULL THEN brand END, 'unknown') AS value, count(*) AS n FROM event GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(t: Tables) -> DataFrame:
    return aggregates.top_values(t.event, F.coalesce(F.when(F.col("location_id").isNotNull(), F.col("brand")), F.lit("unknown")), 10)


@query("SELECT source_id, count(*) AS mentions, count(DISTINCT CASE WHEN entity_type = 'person' THEN entity_id END) AS persons, count(DISTINCT CASE WHEN entity_type = 'event' THEN entity_id END) AS events, count(DISTINCT (entity_type, entity_id)) AS entities, round(avg(confidence), 6) AS confidence FROM mention GROUP BY 1")
def source_stats(t: Tables) -> DataFrame:
    of = lambda kind: F.countDistinct(F.when(F.col("entity_type") == kind, F.col("entity_id")))
    return t.mention.groupBy("source_id").agg(F.count("*").alias("mentions"), of("person").alias("persons"), of("event").alias("events"), F.countDistinct(F.struct("entity_type", "entity_id")).alias("entities"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT entity_id AS person_id, count(DISTINCT source_id) AS sources FROM mention WHERE entity_type = 'person' GROUP BY 1 HAVING count(DISTINCT source_id) >= 600")
def source_persons_having(t: Tables) -> DataFrame:
    return t.mentions("person").groupBy(F.col("entity_id").alias("person_id")).agg(F.countDistinct("source_id").alias("sources")).filter("sources >= 600")


@query("SELECT id, sum(n)::BIGINT AS degree FROM (SELECT entity_id AS id, count(*) AS n FROM mention WHERE entity_type = 'event' GROUP BY 1 UNION ALL SELECT id, count(*) FROM event WHERE location_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def degree_count(t: Tables) -> DataFrame:
    return aggregates.degrees((t.mentions("event"), "entity_id"), (t.event.filter("location_id is not null"), "id"))


@query("""SELECT p.id, coalesce(n, 0) AS mentions, coalesce(s, 0) AS sources, CASE WHEN coalesce(n, 0) >= 50 THEN 'S' WHEN n >= 20 THEN 'A' WHEN n >= 5 THEN 'B' WHEN n >= 1 THEN 'C' ELSE 'D' END AS tier
FROM event p LEFT JOIN (SELECT entity_id, count(*) AS n, count(DISTINCT source_id) AS s FROM mention WHERE entity_type = 'event' GROUP BY 1) m ON p.id = m.entity_id""")
def entity_tiers(t: Tables) -> DataFrame:
    return aggregates.entity_tiers(t.event.select("id"), t.mentions("event"))


@query("SELECT entity_type, CASE WHEN round(confidence, 6) >= 0.9 THEN 'high' WHEN round(confidence, 6) >= 0.7 THEN 'medium' WHEN round(confidence, 6) >= 0.4 THEN 'low' ELSE 'very_low' END AS band, count(*) AS n FROM mention GROUP BY ALL")
def confidence_bands(t: Tables) -> DataFrame:
    return aggregates.confidence_bands(t.mention)


@query("SELECT CASE WHEN y < 0 THEN 'BCE' ELSE 'CE' END AS era, (abs(y) // 100 + 1)::BIGINT AS century, count(*) AS n, min(y)::BIGINT AS first_year, max(y)::BIGINT AS last_year FROM (SELECT birth_year AS y FROM person UNION ALL SELECT death_year FROM person) WHERE y IS NOT NULL GROUP BY 1, 2")
def century_histogram(t: Tables) -> DataFrame:
    return aggregates.century_histogram(t.person, "birth_year", "death_year").select("era", *_long("century"), "n", *_long("first_year", "last_year"))


@query("""SELECT title, arg_max(category, (importance, -id)) AS category, arg_min(date_end, id) FILTER (date_end IS NOT NULL)::BIGINT AS date_end, max(importance)::BIGINT AS confidence, count(*) AS n, count(DISTINCT brand) AS docs FROM event GROUP BY 1""")
def ner_merge_aggregate(t: Tables) -> DataFrame:
    out = aggregates.merge_mentions(t.event, "title", "id", ["category"], ["date_end"], "importance", "brand")
    return out.select("title", "category", *_long("date_end", "confidence"), "n", "docs")


@query("SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, CASE WHEN s < 2 THEN 8 WHEN s < 5 THEN 7 WHEN s < 10 THEN 6 WHEN s < 20 THEN 5 ELSE 4 END::BIGINT AS zoom FROM location, (SELECT greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) AS s FROM location) GROUP BY s")
def map_view(t: Tables) -> DataFrame:
    return aggregates.map_view(t.location).select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), *_long("zoom"))


@query("SELECT (floor(p_retailprice / 100) * 100)::BIGINT AS band, count(*) AS n FROM part GROUP BY 1")
def score_bands(t: Tables) -> DataFrame:
    return aggregates.score_bands(t.part, "p_retailprice", 100)


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent FROM orders GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


# ---- windows

@query("""SELECT source_id, chunk_index, entity_id, confidence, rank FROM (SELECT source_id, chunk_index::BIGINT AS chunk_index, entity_id, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY source_id ORDER BY round(confidence, 6) DESC, chunk_index, entity_id) AS rank FROM mention WHERE entity_type = 'person') WHERE rank <= 3""")
def source_top_contexts(t: Tables) -> DataFrame:
    m = t.mentions("person").withColumn("confidence", F.round("confidence", 6))
    return windows.top_n(m, ["source_id"], [F.desc("confidence"), F.asc("chunk_index"), F.asc("entity_id")], 3).select("source_id", *_long("chunk_index"), "entity_id", "confidence", *_long("rank"))


@query("""SELECT title, id, n AS group_size FROM (SELECT title, id, count(*) OVER (PARTITION BY title) AS n, row_number() OVER (PARTITION BY title ORDER BY importance * 10 + CASE WHEN location_id IS NULL THEN 0 ELSE 10 END DESC, id) AS k FROM event) WHERE k = 1""")
def keep_best_duplicate(t: Tables) -> DataFrame:
    score = F.col("importance") * 10 + F.when(F.col("location_id").isNotNull(), 10).otherwise(0)
    return windows.keep_best(t.event, ["title"], score, "id").select("title", "id", "group_size")


@query("""SELECT id, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k::VARCHAR END AS slug FROM (SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS slug, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') ORDER BY id) - 1 AS k FROM event)""")
def unique_slugs(t: Tables) -> DataFrame:
    return windows.unique_slugs(t.event.select("id", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-").alias("base")), "base", "id").select("id", "slug")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events""")
def rolling_average(t: Tables) -> DataFrame:
    return windows.moving_average(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 30).select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query("""SELECT event_id, micros, CASE WHEN micros > 0 THEN round(value * 1e6 / micros, 6) END AS rate FROM (SELECT event_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS micros FROM events)""")
def lag_duration(t: Tables) -> DataFrame:
    return windows.durations(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "event_id", "value").select("event_id", "micros", F.round("rate", 6).alias("rate"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) > 4 AS refused FROM events""")
def rate_limit_hourly(t: Tables) -> DataFrame:
    """The limit over a day, as the table has few rows an hour."""
    return windows.hourly_count(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 4, 24).select("event_id", "recent", "refused")


@query("""SELECT avg_first, avg_last, CASE WHEN avg_last > avg_first * 1.2 THEN 'up' WHEN avg_last < avg_first * 0.8 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT round(avg(value) FILTER (a <= 10), 6) AS avg_first, round(avg(value) FILTER (b <= 10), 6) AS avg_last FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS a, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS b FROM events))""")
def trend(t: Tables) -> DataFrame:
    """First ten against last ten: two top-k scans, no global window."""
    first = t.events.orderBy("ts", "event_id").limit(10).agg(F.round(F.avg("value"), 6).alias("avg_first"))
    last = t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).agg(F.round(F.avg("value"), 6).alias("avg_last"))
    up, down = F.col("avg_last") > F.col("avg_first") * 1.2, F.col("avg_last") < F.col("avg_first") * 0.8
    return first.crossJoin(last).select("avg_first", "avg_last", F.when(up, "up").when(down, "down").otherwise("flat").alias("trend"))


@query("""WITH RECURSIVE y AS (SELECT DISTINCT location_id, date_start AS y FROM event WHERE location_id IS NOT NULL), r AS (SELECT location_id, min(y) AS s FROM y GROUP BY 1 UNION ALL SELECT r.location_id, (SELECT min(y.y) FROM y WHERE y.location_id = r.location_id AND y.y > r.s + 300) FROM r WHERE r.s IS NOT NULL)
SELECT e.id, max(r.s)::BIGINT AS batch_start FROM event e JOIN r ON e.location_id = r.location_id AND r.s <= e.date_start GROUP BY e.id""")
def era_batches(t: Tables) -> DataFrame:
    return windows.anchored_batches(t.event.filter("location_id is not null"), "location_id", "date_start", "id", 300).select("id", F.col("batch_start").cast("long").alias("batch_start"))


@query()
def greedy_spatial_clusters(t: Tables) -> DataFrame:
    """All customers' places in the order of keys, each spread around its nation's; seeds take what is within 500 km."""
    at = t.location.select(F.col("id").alias("c_nationkey"), "latitude", "longitude")
    shift = lambda by, most: F.pmod(F.xxhash64("c_custkey", F.lit(by)), F.lit(most)) / 10 - most / 20
    return graph.greedy_places(t.customer.join(at, "c_nationkey").select(F.col("c_custkey").alias("id"), (F.col("latitude") + shift(1, 80)).alias("latitude"), (F.col("longitude") + shift(2, 300)).alias("longitude")))


@query("""SELECT location_id::BIGINT AS location_id, min(date_start)::BIGINT AS first_year, max(coalesce(date_end, date_start))::BIGINT AS last_year, count(*) AS n FROM event WHERE location_id IS NOT NULL GROUP BY 1""")
def chain_span(t: Tables) -> DataFrame:
    return t.event.filter("location_id is not null").groupBy(F.col("location_id").cast("long").alias("location_id")).agg(F.min("date_start").cast("long").alias("first_year"), F.max(F.coalesce("date_end", "date_start")).cast("long").alias("last_year"), F.count("*").alias("n"))


# ---- changes of tables

@query("""WITH old AS (SELECT p_partkey AS id, p_brand AS brand, p_size::BIGINT AS size FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id, 'new' AS brand, p_size + 1000 AS size FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.brand, n.brand) AS brand, coalesce(n.size, o.size)::BIGINT AS size FROM old o FULL JOIN new n ON o.id = n.id""")
def edge_upsert(t: Tables) -> DataFrame:
    """size is replaced, brand only filled."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))
    new = p.filter("id % 2 = 0").select("id", F.lit("new").alias("brand"), (F.col("size") + 1000).alias("size"))
    return sinks.upsert(p.filter("id % 3 <> 0"), new, ["id"], ("brand",))


@query("""WITH old AS (SELECT DISTINCT p_name AS alias, 'old' AS origin FROM part WHERE p_partkey % 2 = 0), new AS (SELECT DISTINCT p_name AS alias, 'new' AS origin FROM part)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE alias NOT IN (SELECT alias FROM old)""")
def alias_insert_ignore(t: Tables) -> DataFrame:
    old = t.part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("alias"), F.lit("old").alias("origin")).distinct()
    return sinks.insert_ignore(old, t.part.select(F.col("p_name").alias("alias"), F.lit("new").alias("origin")), ["alias"])


@query("SELECT id, name FROM person WHERE id IN (SELECT entity_id FROM mention WHERE entity_type = 'person' AND confidence < 0.91)")
def compact_tables(t: Tables) -> DataFrame:
    kept, _ = sinks.compact(t.person.select("id", "name"), (t.mentions("person").filter("confidence < 0.91"), "entity_id"))
    return kept


@query("SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 50")
def search_history(t: Tables) -> DataFrame:
    return filters.page(t.conversations.filter("role = 'user'"), [F.desc("conv_id"), F.desc("turn")], 0, 50).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("SELECT id, title, length(coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE category END, ''))::BIGINT AS n FROM event WHERE length(coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE category END, '')) < 15 ORDER BY n, id LIMIT 200")
def enrichment_worklist(t: Tables) -> DataFrame:
    n = F.length(F.coalesce(F.when(F.col("id") % 4 != 0, F.col("category")), F.lit(""))).cast("long")
    return t.event.select("id", "title", n.alias("n")).filter("n < 15").orderBy("n", "id").limit(200)


@query("""SELECT id, 10 * CASE WHEN importance > 3 THEN 1 ELSE 0 END + least(5, greatest(1, importance // 2))::BIGINT AS points, round(CASE WHEN date_end IS NULL THEN greatest(0.0, least(1.0, 0.5 - 0.2)) ELSE greatest(0.0, least(1.0, 0.5 + 0.1)) END, 6)::DOUBLE AS confidence FROM event""")
def verification(t: Tables) -> DataFrame:
    points = F.when(F.col("importance") > 3, 10).otherwise(0) + F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("importance") / 2)))
    return t.event.select("id", points.cast("long").alias("points"), F.round(scores.verified(F.lit(0.5), F.col("date_end").isNotNull()), 6).alias("confidence"))

"""Histograms, shares, grids, tiers, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.functions import geo, scores, years


def year_histogram(events: DataFrame, width: int, low: int, high: int, mode: str) -> DataFrame:
    start = years.bucket(F.col("date_start"), width, mode)
    out = events.filter(F.col("date_start").between(low, high)).groupBy(start.alias("year_start")).agg(F.count("*").alias("n"))
    return out.select("year_start", (F.col("year_start") + width - 1).alias("year_end"), "n", years.bucket_label(F.col("year_start"), width).alias("label"))


def timeline_density(events: DataFrame, low: int, high: int, segments: int) -> DataFrame:
    """Events per segment over the fullest segment's; an event at `high` itself is outside."""
    at = F.floor((F.col("date_start") - low) * segments / F.lit(high - low))
    counts = events.filter((F.col("date_start") >= low) & (F.col("date_start") < high)).groupBy(at.alias("segment")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))  # one row
    return counts.crossJoin(F.broadcast(most)).select("segment", "n", (F.col("n") / F.greatest("most", F.lit(1))).alias("density"))


def grid_clusters(events: DataFrame, locations: DataFrame, degrees: float) -> DataFrame:
    """Events per cell of a grid over their locations: the cell's middle, count, first and last year."""
    row, col = geo.cell(F.col("latitude"), degrees), geo.cell(F.col("longitude"), degrees)
    placed = events.join(locations, events["location_id"] == locations["id"])
    cells = placed.groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"), F.min("date_start").alias("first_year"), F.max("date_start").alias("last_year"))
    return cells.select(((F.col("row") + 0.5) * degrees).alias("latitude"), ((F.col("col") + 0.5) * degrees).alias("longitude"), "n", "first_year", "last_year")


def zoom_clusters(markers: DataFrame, altitude: float) -> DataFrame:
    """Markers within a zoom's cell as one at their mean place; no clustering near the ground."""
    size = geo.zoom_radius_km(altitude) / geo.DEGREE_KM
    if not size:
        return markers.select("latitude", "longitude", F.lit(1).cast("long").alias("n"), F.col("id").alias("first_id"))
    keys = [geo.cell(F.col("latitude"), size).alias("row"), geo.cell(F.col("longitude"), size).alias("col")]
    return markers.groupBy(*keys).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("n"), F.min("id").alias("first_id")).drop("row", "col")


def shares(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Count and share of every value, in percent; with a limit, of the rows that the limit leaves."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if limit:
        counts = counts.orderBy(F.desc("n"), F.asc(key)).limit(limit)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def top_values(df: DataFrame, key: Column, k: int, label: str = "value") -> DataFrame:
    return df.groupBy(key.alias(label)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(label)).limit(k)


def degrees(*edges: tuple[DataFrame, str]) -> DataFrame:
    """How many edges an entity has over several edge tables, each with the column that names it."""
    counts = [df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")) for df, key in edges]
    all_counts = counts[0]
    for c in counts[1:]:
        all_counts = all_counts.unionByName(c)
    return all_counts.groupBy("id").agg(F.sum("n").alias("degree"))


def entity_tiers(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions, sources and tier of every entity, those without any included."""
    own = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("source_id").alias("sources"))
    joined = entities.join(own, entities["id"] == own["entity_id"], "left")
    n = F.coalesce("mentions", F.lit(0))
    return joined.select("id", n.alias("mentions"), F.coalesce("sources", F.lit(0)).alias("sources"), scores.tier(n).alias("tier"))


def confidence_bands(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_type", scores.confidence_band(F.round("confidence", 6)).alias("band")).agg(F.count("*").alias("n"))


def century_histogram(spans: DataFrame, *cols: str) -> DataFrame:
    """Years in any of the columns by century and era; null years do not count."""
    each = spans.select(F.explode(F.array(*cols)).alias("year")).filter("year is not null")
    century = F.floor(F.abs("year") / 100) + 1
    return each.groupBy(years.era(F.col("year")).alias("era"), century.alias("century")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def merge_mentions(rows: DataFrame, key: str, order: str, attributes: list[str], first_known: list[str], confidence: str, doc: str) -> DataFrame:
    """One row per key: attributes of the most confident row (first of equals), the first known value of others,
    the greatest confidence, how many rows and documents."""
    best = F.struct(F.col(confidence), -F.col(order))
    aggs = [F.max_by(a, best).alias(a) for a in attributes] + [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_known]
    return rows.groupBy(key).agg(*aggs, F.max(confidence).alias("confidence"), F.count("*").alias("n"), F.countDistinct(doc).alias("docs"))


def map_view(places: DataFrame) -> DataFrame:
    """Middle of the places and a zoom for their spread: one row."""
    spread = F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude"))
    return places.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), geo.view_zoom(spread).alias("zoom"))


def score_bands(scored: DataFrame, score: str, step: int = 10) -> DataFrame:
    return scored.groupBy((F.floor(F.col(score) / step) * step).cast("long").alias("band")).agg(F.count("*").alias("n"))

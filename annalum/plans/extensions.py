"""Queries beyond the knowledge model: streams and summaries of several groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.plans.catalog import query
from annalum.schema import Tables
from annalum.streaming import logs


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(t: Tables) -> DataFrame:
    """Events per hour and type, through a stream that takes in all files."""
    stream = logs.log(t.spark, f"{t.folder}/events.parque[t]", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return logs.drained(logs.window_counts(stream, "ts", "event_type"), t.spark).select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("SELECT country, e.category, grouping(country)::BIGINT AS all_countries, grouping(e.category)::BIGINT AS all_categories, count(*) AS n FROM event e JOIN location l ON e.location_id = l.id GROUP BY ROLLUP (country, e.category)")
def country_category_rollup(t: Tables) -> DataFrame:
    placed = t.event.select("location_id", "category").join(t.location.select(F.col("id").alias("location_id"), "country"), "location_id")
    return placed.rollup("country", "category").agg(F.grouping("country").cast("long").alias("all_countries"), F.grouping("category").cast("long").alias("all_categories"), F.count("*").alias("n"))


@query("SELECT entity_type, approx_count_distinct(source_id) > 0 AS any_source, round(quantile_cont(confidence, 0.5), 6) AS median FROM mention GROUP BY 1")
def confidence_median(t: Tables) -> DataFrame:
    return t.mention.groupBy("entity_type").agg((F.approx_count_distinct("source_id") > 0).alias("any_source"), F.round(F.percentile("confidence", F.lit(0.5)), 6).alias("median"))

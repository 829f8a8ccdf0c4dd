"""Strings that are alike: joins by ratio, reconciliation by year, place and title, mixed ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.functions import strings
from annalum.operators import similar_strings
from annalum.plans.catalog import query
from annalum.schema import Tables


@query()
def similar_titles(t: Tables) -> DataFrame:
    """Customers' and suppliers' names, and titles with their classes, that are alike to 0.9: no SQL has the ratio."""
    names = t.person.select("name").union(t.customer.select("c_name"))
    titles = t.event.select(F.concat_ws(" ", "title", "category", "brand").alias("name"))
    every = names.union(titles).select(F.lower("name").alias("s"))
    return similar_strings.similar(every, every, 0.9).filter("a_s < b_s").select("a_s", "b_s", F.round("ratio", 6).alias("ratio"))


@query()
def reconcile_by_place(t: Tables) -> DataFrame:
    """Events against records of the same years at places close by, by their titles."""
    at = t.location.select(F.col("id").alias("location_id"), "latitude", "longitude")
    known = t.event.join(at, "location_id").select("id", F.lower("title").alias("title"), F.col("date_start").alias("year"), "latitude", "longitude")
    moved = known.select(
        "id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("the "), "title")).when(F.col("id") % 4 == 1, F.concat(F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" tool"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("id") % 7 != 0, F.col("year")).alias("year"), (F.col("latitude") + 0.05).alias("latitude"), (F.col("longitude") - 0.08).alias("longitude"))
    return similar_strings.reconcile_by_place(known, moved).select("known_id", "found_id", "match", F.round("confidence", 6).alias("confidence"))


@query()
def combined_name_scores(t: Tables) -> DataFrame:
    """Distinct titles against titles with a shared word: Jaro-Winkler, token set and ratio, mixed."""
    titles = t.event.select("title").distinct()
    words = titles.select("title", F.explode(F.split("title", " ")).alias("word"))
    met = words.select(F.col("title").alias("a"), "word").join(words.select(F.col("title").alias("b"), "word"), "word").filter("a < b").select("a", "b").distinct()
    return met.select("a", "b", F.round(strings.combined(F.col("a"), F.col("b")), 6).alias("score"))

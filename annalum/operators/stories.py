"""Stories: the events of a person, a place or a period in order, each with a sentence; answers without a model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions import years
from annalum.operators.windows import top_n

#: The sentences of a story and of an answer.
SENTENCES = {
    "person": "In {year}, {subject} was involved in {event}.",
    "place": "In {year}, {event} took place at {subject}.",
    "era": "During the {subject}, {event} occurred in {year}.",
    "event": "{event} occurred in {year}.",
}
UNKNOWN = "I don't have specific information about '{query}' in my database. Please try a different query."
#: The connection between a segment and the one before it.
CONNECTIONS = {"person": "follows", "place": "follows", "era": "parallel", "event": "causes"}


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its braces; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def told(kind: str, segments: DataFrame, subject: str) -> DataFrame:
    """segments (title, date_start, segment and the subject's name) with their sentence and connection. A null year,
    title or name makes the sentence null; the first segment has no connection."""
    year = F.concat(F.abs("date_start").cast("string"), F.lit(" "), years.era(F.col("date_start")))
    sentence = filled(SENTENCES[kind], year=year, subject=F.col(subject), event=F.col("title"))
    link = F.when(F.col("segment") > 1, F.lit(CONNECTIONS[kind]))
    return segments.withColumns({"narrative": sentence, "connection": link})


def _first_of_years(events: DataFrame, n: int) -> DataFrame:
    """Each year's n most important events: no others can be among the n first of a range of years. There are a few
    thousand years, however many events."""
    dated = events.select(F.col("id").alias("event_id"), "title", "date_start", "importance").filter("date_start is not null")
    return top_n(dated, ["date_start"], [F.desc_nulls_last("importance"), F.asc("event_id")], n).drop("rank")


def _by_importance() -> list[Column]:
    return [F.desc_nulls_last("importance"), F.asc("date_start"), F.asc("event_id")]


def person_segments(persons: DataFrame, events: DataFrame, links: DataFrame, n: int = 10, before: int = 20, after: int = 10, assumed: int = 80, width: int = 50) -> DataFrame:
    """The first n linked events of each person by date; for people without any, the n most important of their time.

    links: person_id, event_id; copies count once. A person without links and without birth has no story. Lives and
    years meet by blocks of years. Returns person_id, event_id, title, date_start, segment, origin.
    """
    known = events.select(F.col("id").alias("event_id"), "title", "date_start")
    direct = links.select("person_id", "event_id").distinct().join(known, "event_id")
    first = top_n(direct, ["person_id"], [F.asc_nulls_last("date_start"), F.asc("event_id")], n, "segment").withColumn("origin", F.lit("linked"))
    alone = persons.filter("birth_year is not null").select(F.col("id").alias("person_id"), "birth_year", "death_year").join(direct.select("person_id"), "person_id", "left_anti")
    span = alone.select("person_id", (F.col("birth_year") - before).alias("low"), (F.coalesce("death_year", F.col("birth_year") + assumed) + after).alias("high"))
    block = lambda c: F.floor(F.col(c) / width)
    span = span.filter("low <= high").withColumn("block", F.explode(F.sequence(block("low"), block("high"))))
    lived = span.join(_first_of_years(events, n).withColumn("block", block("date_start")), "block").filter("date_start between low and high")
    rest = top_n(lived, ["person_id"], _by_importance(), n, "segment").withColumn("origin", F.lit("lifetime"))
    cols = ["person_id", "event_id", "title", "date_start", "segment", "origin"]
    return first.select(cols).unionByName(rest.select(cols))


def place_segments(events: DataFrame, start: int | None = None, end: int | None = None, n: int = 10) -> DataFrame:
    """The first n events of each place by date, within years if given; open bounds take undated events too, last."""
    own = events.filter("location_id is not null").select("location_id", F.col("id").alias("event_id"), "title", "date_start")
    for bound, keep in ((start, F.col("date_start") >= F.lit(start)), (end, F.col("date_start") <= F.lit(end))):
        own = own if bound is None else own.filter(keep)
    return top_n(own, ["location_id"], [F.asc_nulls_last("date_start"), F.asc("event_id")], n, "segment")


def era_segments(events: DataFrame, eras: list[tuple[str, int, int | None]], n: int = 10, today: int = 2025) -> DataFrame:
    """The n most important events of each era of a curated list; an open era ends today. An event may be in several."""
    first = _first_of_years(events, n)
    within = [F.when(F.col("date_start").between(low, today if high is None else high), F.lit(name)) for name, low, high in eras]
    named = first.withColumn("era", F.explode(F.array_compact(F.array(*within))))
    return top_n(named, ["era"], _by_importance(), n, "segment").select("era", "event_id", "title", "date_start", "segment")


def answer(query: Column, year: Column, title: Column, date: Column, description: Column, name: Column, life: Column, biography: Column, most: int = 500) -> Column:
    """An answer from the first event and the first person found; texts are cut, missing parts are left out."""
    said = lambda ok, *parts: F.when(ok, F.concat(*parts)).otherwise(F.lit(""))
    body = lambda c: F.coalesce(F.concat(F.lit("\n"), F.substring(F.nullif(c, F.lit("")), 1, most)), F.lit(""))
    head = lambda bold, shown: [F.lit("\n\n**"), bold, F.lit("** ("), F.coalesce(shown, F.lit("None")), F.lit(")")]
    when = said(year.isNotNull(), F.lit("Regarding events around "), F.abs(year).cast("string"), F.lit(" "), years.era(year), F.lit(":"))
    found = F.concat(when, said(title.isNotNull(), *head(title, date), body(description)), said(name.isNotNull(), *head(name, life), body(biography)))
    return F.when(title.isNull() & name.isNull(), filled(UNKNOWN, query=query)).otherwise(found)

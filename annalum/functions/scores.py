"""Scores of links, lifespans, records and matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base strength of a layer.
LAYER_BASE = {"person": 10.0, "location": 5.0, "causal": 1.0, "thematic": 0.5}


def source_factor(n: Column) -> Column:
    return F.when(n > 0, n * F.pow(1 + F.ln(n.cast("double")), F.lit(1.5))).otherwise(F.lit(0.0))


def strength(layer: str, sources: Column, distance: Column, layers: Column | int = 1) -> Column:
    """Base of the layer, sources with emphasis, closeness within 50 years, two more for every further layer."""
    near = F.coalesce(F.greatest(F.lit(0.0), (50 - distance) * 0.02), F.lit(0.0))
    more = (layers - 1) * 2.0 if isinstance(layers, int) else (layers - 1) * F.lit(2.0)
    return F.lit(LAYER_BASE.get(layer, 1.0)) + source_factor(sources) + near + more


def direction(year_a: Column, year_b: Column, within: int = 10) -> Column:
    gap = year_b - year_a
    return F.when(gap.isNull(), F.lit("undirected")).when(F.abs(gap) <= within, F.lit("bidirectional")).when(gap > within, F.lit("forward")).otherwise(F.lit("backward"))


def lifetime_overlap(birth_a: Column, death_a: Column, birth_b: Column, death_b: Column, assumed: int = 70) -> tuple[Column, Column]:
    """(score, years apart): 10, 7 or 5 by shared years; 2, 0 or -5 by the gap; 0 and null if a life has no year."""
    start = lambda b, d: F.coalesce(b, d - assumed)
    end = lambda b, d: F.coalesce(d, b + assumed)
    low, high = F.greatest(start(birth_a, death_a), start(birth_b, death_b)), F.least(end(birth_a, death_a), end(birth_b, death_b))
    known = F.coalesce(birth_a, death_a).isNotNull() & F.coalesce(birth_b, death_b).isNotNull()
    shared, gap = high - low, low - high
    points = F.when(shared >= 20, 10).when(shared >= 10, 7).when(shared >= 0, 5).when(gap <= 50, 2).when(gap <= 100, 0).otherwise(-5)
    return F.when(known, points).otherwise(F.lit(0)), F.when(known, F.greatest(gap, F.lit(0)))


def record_quality(description: Column, has_wiki: Column, has_image: Column, importance: Column, relations: Column, has_place: Column, has_local: Column) -> Column:
    flag = lambda c, points: F.when(c, points).otherwise(0)
    return F.least(F.floor(F.coalesce(F.length(description), F.lit(0)) / 10), F.lit(50)) + flag(has_wiki, 50) + flag(has_image, 20) + F.coalesce(importance, F.lit(0)) * 10 + relations * 5 + flag(has_place, 10) + flag(has_local, 5)


def year_proximity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 10 * F.abs(a - b))


def tier(mentions: Column) -> Column:
    return F.when(mentions >= 50, "S").when(mentions >= 20, "A").when(mentions >= 5, "B").when(mentions >= 1, "C").otherwise("D")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").when(confidence >= 0.4, "low").otherwise("very_low")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def verified(confidence: Column, supported: Column) -> Column:
    """Confidence after verification: 0.1 more with support, 0.2 less without, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(supported, confidence + 0.1).otherwise(confidence - 0.2)))

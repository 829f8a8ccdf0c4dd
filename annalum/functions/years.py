"""Signed years: buckets, labels, spans. Null years give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(year: Column, width: int, mode: str = "floor") -> Column:
    """First year of the bucket. floor: -490 by 100 is -500. trunc: toward zero, so bucket 0 holds -99 to 99."""
    if mode == "floor":
        return year - F.pmod(year, F.lit(width))
    if mode == "trunc":
        return year - year % width
    raise ValueError("mode is floor or trunc")


def bucket_label(start: Column, width: int) -> Column:
    end = start + (width - 1)
    return F.when(start < 0, F.concat(F.abs(start).cast("string"), F.lit("-"), F.abs(end).cast("string"), F.lit(" BCE"))).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" CE")))


def era(year: Column) -> Column:
    return F.when(year < 0, F.lit("BCE")).otherwise(F.lit("CE"))


def display(year: Column, precision: Column) -> Column:
    """A date by its precision: century, decade, or the year itself."""
    size = F.abs(year)
    century = F.concat((F.floor(size / 100) + 1).cast("string"), F.lit("th century "), era(year))
    decade = F.concat((size - size % 10).cast("string"), F.lit("s "), era(year))
    return F.when(precision == "century", century).when(precision == "decade", decade).otherwise(F.concat(size.cast("string"), F.lit(" "), era(year)))


def lifespan(birth: Column, death: Column) -> Column:
    """'a-b ERA' within an era, else 'x - y', '?' for a missing year, 'Unknown' without both."""
    shown = lambda y: F.when(y.isNull(), F.lit("?")).otherwise(F.concat(F.abs(y).cast("string"), F.lit(" "), era(y)))
    both = birth.isNotNull() & death.isNotNull() & ((birth < 0) == (death < 0))
    one_era = F.concat(F.abs(birth).cast("string"), F.lit("-"), F.abs(death).cast("string"), F.lit(" "), era(birth))
    return F.when(birth.isNull() & death.isNull(), F.lit("Unknown")).when(both, one_era).otherwise(F.concat(shown(birth), F.lit(" - "), shown(death)))


def active(start: Column, end: Column, year: int | Column) -> Column:
    """A stabbing condition; an open end lasts."""
    return (start <= year) & (end.isNull() | (end >= year))


def alive(birth: Column, death: Column, year: int | Column, assumed: int = 80) -> Column:
    """False without a birth year; without a death year, alive for `assumed` years."""
    return F.coalesce((birth <= year) & (F.coalesce(death, birth + assumed) >= year), F.lit(False))


def valid(start: Column, end: Column, year: int | Column) -> Column:
    """Null bounds are open."""
    return (start.isNull() | (start <= year)) & (end.isNull() | (end >= year))


def overlap(start: Column, end: Column, low: int | Column, high: int | Column) -> Column:
    return (end >= low) & (start <= high)


def parsed(text: Column) -> Column:
    """ISO-like dates to signed years: '-0490-01-01' is -490, '1066' is 1066, anything else null."""
    digits = F.regexp_extract(text, r"^([+-]?\d{1,6})(?:-|$)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def mentioned(text: Column) -> Column:
    """The first year that a text names as 'N BCE', 'N BC' (negative) or 'N CE', 'N AD'; else null."""
    number, mark = F.regexp_extract(text, r"\b(\d{1,4}) ?(BCE|BC|CE|AD)\b", 1), F.regexp_extract(text, r"\b(\d{1,4}) ?(BCE|BC|CE|AD)\b", 2)
    return F.when(mark.startswith("B"), -number.try_cast("int")).when(mark != "", number.try_cast("int"))


def in_text(text: Column) -> tuple[Column, Column]:
    """(year, mark) of the first year with a mark before our era; without one, of our era; without one, the number of
    the first century, marked 'century'. Nulls if there is none."""
    forms = ((r"(?i)\b(\d{1,4})\s*(BCE|BC|B\.C\.(?:E\.)?)", -1), (r"(?i)\b(\d{1,4})\s*(CE|AD|A\.D\.)", 1))
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    century = number(r"(?i)\b(\d{1,4})(?:th|st|nd|rd)\s*century")
    year = F.coalesce(*[number(p) * sign for p, sign in forms], century)
    mark = F.coalesce(*[F.when(number(p).isNotNull(), F.upper(F.regexp_extract(text, p, 2))) for p, _ in forms], F.when(century.isNotNull(), F.lit("century")))
    return year, mark


def lifespan_in_text(text: Column, within: int = 500) -> tuple[Column, Column]:
    """(birth, death) of the first form that the beginning of a text holds: (1769-1821), (c. 1412 - 1431), (born 1950),
    (106 BC - 43 BC)."""
    dash = r"\s*[\u2013-]\s*"
    forms = ((r"\((\d{1,4})" + dash + r"(\d{1,4})\)", 1), (r"\(c\.\s*(\d{1,4})" + dash + r"(\d{1,4})\)", 1), (r"\(born\s+(\d{4})()", 1), (r"\((\d{1,4})\s*BC" + dash + r"(\d{1,4})\s*BC\)", -1))
    start = F.substring(text, 1, within)
    part = lambda i: F.coalesce(*[F.when(start.rlike(p), F.struct((F.regexp_extract(start, p, i).try_cast("int") * sign).alias("y"))) for p, sign in forms])["y"]
    return part(1), part(2)

"""Predicates built from optional parameters. A parameter of None adds nothing; 0 is a value like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of names that are forms of address, in any case, not people.
NOISE = ("Mrs.", "Mrs ", "Miss ", "Mr. ", "Mr ", "Sig.", "Sig ", "Junr", "Senr", "Madame ", "Mme.", "Mlle.")


def every(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def between(col: Column, low=None, high=None) -> Column:
    return every(col >= low if low is not None else None, col <= high if high is not None else None)


def equal(col: Column, value=None) -> Column | None:
    return col == value if value is not None else None


def ends_by(start: Column, end: Column, year: int) -> Column:
    """Ended by a year; without an end, started by it."""
    return (end <= year) | (end.isNull() & (start <= year))


def contains(query: str, *cols: Column) -> Column:
    """Case-insensitive substring in any of the columns; wildcards in the query are plain characters."""
    return any_of(*[F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in cols])


def not_noise(name: Column, prefixes: tuple[str, ...] = NOISE) -> Column:
    return ~any_of(*[F.lower(name).startswith(p.lower()) for p in prefixes])


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a total order: end `order` with the key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_key(name: str | None, allowed: dict[str, str], default: str, descending: bool = True) -> list[Column]:
    """Whitelisted sort column and direction, nulls last."""
    col = F.col(allowed.get(name, allowed[default]))
    return [col.desc_nulls_last() if descending else col.asc_nulls_last()]

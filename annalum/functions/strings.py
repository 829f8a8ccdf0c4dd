"""String similarity: ratios by longest common subsequence, sets of tokens, and their mix, in Arrow batches.

The longest common subsequence is found with one bit per character of the first string: a step per character of the
second adds, subtracts and combines whole numbers. Give the functions distinct pairs. Null on either side gives 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_bits = every  # a zero: a character of a that ends a longer common subsequence than those before it
    for c in b:
        hit = open_bits & where.get(c, 0)
        open_bits = (open_bits + hit | open_bits - hit) & every
    return len(a) - open_bits.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the common length by both lengths; 1 of two empty strings."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    """Of sorted distinct tokens: the best ratio among the shared ones, shared with the first's own, shared with the
    second's own. 1 if one side's tokens are all shared, 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (only_x and only_y):
        return 1.0
    with_x, with_y = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    own = indel_ratio(with_x, with_y)
    return max(own, indel_ratio(shared, with_x), indel_ratio(shared, with_y)) if shared else own


def _udf(f):
    @pandas_udf(DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return over


ratio = _udf(indel_ratio)
token_set_ratio = _udf(token_set)


def combined(a: Column, b: Column) -> Column:
    """Of names in lower case, trimmed: 0.3 Jaro-Winkler, 0.4 token set, 0.3 ratio."""
    from annalum.operators.resolve import jaro_winkler

    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return 0.3 * jaro_winkler(x, y) + 0.4 * token_set_ratio(x, y) + 0.3 * ratio(x, y)

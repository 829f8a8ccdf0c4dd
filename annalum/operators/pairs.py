"""Pairs of what shares a key, with busy keys split.

Pairs of a key are quadratic in its rows, and one join task would make them all. So a key of over `block` rows is cut
into blocks by a hash, and its pairs are dealt as cells: (i, j) for two blocks, a triangle of them within one set, a
rectangle between two. A row of a cut key goes to every cell of its block, a cell holds `block` rows of each side at
most or about so, and cells are spread like keys. Keys below the size are one cell, and their rows are not copied. Where
no key is cut, the cells are the keys, and the join is by them alone.

Rows in their cells are many times the rows that a plan's estimate knows of, so cells are joined by sorting and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BROADCAST_KEYS = 1024, 100_000


def _cut(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """keys and their number of blocks, of keys with over `block` rows."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).filter("_blocks > 1")


def _with_blocks(rows: DataFrame, cut: DataFrame, keys: list[str], few: bool, name: str) -> DataFrame:
    found = rows.join(F.broadcast(cut) if few else cut, keys, "left")
    return found.withColumn(name, F.coalesce("_blocks", F.lit(1))).drop("_blocks")


def _own(values: list[str], blocks: str) -> Column:
    return F.pmod(F.xxhash64(*values, F.lit(1)), F.col(blocks)).cast("int")


def _named(df: DataFrame, values: list[str], side: str) -> list[Column]:
    return [F.col(v).alias(f"{side}_{v}") for v in values]


def within(rows: DataFrame, keys: list[str], order: str, values: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """keys, a_*, b_* of every two rows of a key with a_<order> < b_<order>. Rows are few columns: keys, order, values."""
    values = [order, *(values or [])]
    rows = rows.select(*keys, *values)
    cut = _cut(rows, keys, block)
    n = cut.count()
    if not n:
        both = rows.select(*keys, *_named(rows, values, "a")).join(rows.select(*keys, *_named(rows, values, "b")), keys)
        return both.filter(F.col(f"a_{order}") < F.col(f"b_{order}"))
    few = n <= BROADCAST_KEYS
    placed = _with_blocks(rows, cut, keys, few, "_n").withColumn("_own", _own([order], "_n"))
    # Cells are (i, j) with i <= j: a row is the first of a pair in those that begin with its block, the second in those that end so.
    left = placed.select(*keys, *_named(rows, values, "a"), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_j"))
    right = placed.select(*keys, *_named(rows, values, "b"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    a, b = F.col(f"a_{order}"), F.col(f"b_{order}")
    met = left.hint("merge").join(right, [*keys, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) & (a != b) | (a < b))
    turned = lambda v, side: F.when(a < b, F.col(f"a_{v}" if side == "a" else f"b_{v}")).otherwise(F.col(f"b_{v}" if side == "a" else f"a_{v}")).alias(f"{side}_{v}")
    return met.select(*keys, *[turned(v, "a") for v in values], *[turned(v, "b") for v in values])


def between(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], block: int = BLOCK, spread: bool = False) -> DataFrame:
    """keys and the columns of every row of left with every row of right of the same key; value names are unlike.

    spread: cells stay in as many tasks as shuffles have partitions, where what pairs cost is far above what rows weigh."""
    left, right = left.select(*keys, *left_values), right.select(*keys, *right_values)
    cuts = [_cut(left, keys, block), _cut(right, keys, block)]
    counts = [c.count() for c in cuts]
    if not any(counts):
        return left.join(right, keys)
    few = [n <= BROADCAST_KEYS for n in counts]

    def placed(rows: DataFrame, values: list[str], mine: int) -> DataFrame:
        both = _with_blocks(rows, cuts[mine], keys, few[mine], "_mine")
        both = _with_blocks(both, cuts[1 - mine], keys, few[1 - mine], "_theirs")
        own, all_others = _own(values, "_mine"), F.explode(F.sequence(F.lit(0), F.col("_theirs") - 1))
        i, j = (own.alias("_i"), all_others.alias("_j")) if mine == 0 else (all_others.alias("_i"), own.alias("_j"))
        return both.select(*keys, *values, i, j)

    cells = [placed(left, left_values, 0), placed(right, right_values, 1)]
    if spread:
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = [c.repartition(n, *keys, "_i", "_j") for c in cells]
    return cells[0].hint("merge").join(cells[1], [*keys, "_i", "_j"]).drop("_i", "_j")

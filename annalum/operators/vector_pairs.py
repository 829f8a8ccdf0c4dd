"""Cosines of all pairs of vectors of a group, in cells of two blocks, as products of matrices.

All pairs are quadratic in a group. A group of over BLOCK rows is cut into blocks by a hash, pairs of blocks are cells, and
cells are dealt over tasks and sorted there: a task holds the two blocks of one cell, and of their product STEP rows at a
time. A row goes to one cell for each block that it meets; what is shuffled for that is one vector a cell, not one a pair.
What a cell finds leaves it in pieces, and of nearest vectors only the k best of a row leave its cell.

Vectors that are null, empty, or have a null part have no cosine, nor have two of different lengths. That of a vector of
length zero or with a part that is not finite is NaN, which is above every number, as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.operators.windows import top_n
from annalum.sources.shared import kept

BLOCK, STEP, PIECE, MOST_TASKS = 8192, 256, 100_000, 4096


def _known(vectors: DataFrame, group: Column, key: str, vector: str, *more: Column) -> DataFrame:
    """g, id, v and more, of what has a cosine; written once, as it is counted and dealt."""
    rows = vectors.select(group.alias("g"), F.col(key).alias("id"), F.col(vector).alias("v"), *more)
    return rows.filter("g is not null and id is not null and size(v) > 0").filter(~F.exists("v", lambda x: x.isNull())).withColumn("size", F.size("v"))


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    return rows.groupBy("g", "size").agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(1)), F.col(blocks)).cast("int")


def _in_cells(rows: DataFrame, cells: int) -> DataFrame:
    """Rows (g, size, i, j, side, ...) with the rows of a cell behind one another, those of side 0 first, by id."""
    return rows.repartition(max(1, min(2 * cells, MOST_TASKS)), "g", "size", "i", "j").sortWithinPartitions("g", "size", "i", "j", "side", "id")


def _matrix(parts: list[pa.Array], size: int) -> np.ndarray:
    """Rows of length one."""
    v = np.concatenate([p.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for p in parts]).reshape(-1, size)
    with np.errstate(all="ignore"):
        return v / np.sqrt((v * v).sum(1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch], found: Callable) -> Iterator[pa.RecordBatch]:
    """The rows of one cell at a time, each side as (ids, unit vectors), to found(g, i, j, left, right)."""
    cell, sides = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if cell is not None:
            ready = [(pa.concat_arrays([p for p, _ in side]), _matrix([v for _, v in side], cell[1])) if side else None for side in sides]
            yield from found(cell[0], cell[2], cell[3], *ready)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in ("g", "size", "i", "j", "side"):
            c = batch.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(batch.column(c)[int(a)].as_py() for c in ("g", "size", "i", "j"))
            if here != cell:
                yield from done()
                cell, sides = here, ([], [])
            part = batch.slice(int(a), int(b - a))
            sides[part.column("side")[0].as_py()].append((part.column("id"), part.column("v")))
    yield from done()


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False)


def _alike(g, i: int, j: int, left, right, least: float, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell of at least `least`, the smaller id first."""
    other = left if i == j else right
    if left is None or other is None:
        return
    (a_ids, a), (b_ids, b) = left, other
    a_key, b_key = _numbers(a_ids), _numbers(b_ids)
    for at in range(0, len(a), STEP):
        first = at if i == j else 0  # rows stand by id, so the ones before are smaller
        with np.errstate(all="ignore"):
            s = a[at : at + STEP] @ b[first:].T
        row, col = np.nonzero(~(s < least))
        s = s[row, col]
        row, col = row + at, col + first
        keep = a_key[row] < b_key[col] if i == j else a_key[row] != b_key[col]
        row, col, s = row[keep], col[keep], s[keep]
        for k in range(0, len(row), PIECE):
            r, c = row[k : k + PIECE], col[k : k + PIECE]
            x, y = a_ids.take(pa.array(r)), b_ids.take(pa.array(c))
            turn = pa.array((a_key[r] > b_key[c]).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(r), kind), pc.if_else(turn, y, x), pc.if_else(turn, x, y), pa.array(s[k : k + PIECE])], names)


def _nearest(g, i: int, j: int, left, right, k: int, least: float, digits: int) -> Iterator[pa.RecordBatch]:
    """Of every row of the left side the k best of the right one, ties in rounded similarity by id."""
    if left is None or right is None:
        return
    (a_ids, a), (b_ids, b) = left, right
    a_key, b_key = _numbers(a_ids), _numbers(b_ids)
    for at in range(0, len(a), STEP):
        with np.errstate(all="ignore"):
            s = a[at : at + STEP] @ b.T
        own = a_key[at : at + STEP]
        for r, c in _same(own, b_key):
            s[r, c] = -np.inf
        s[s < least] = -np.inf
        rounded, rows, out = np.round(s, digits), np.arange(len(s)), []
        for _ in range(min(k, s.shape[1])):  # the first of the largest is that of the smallest id
            best = rounded.argmax(1)
            value = s[rows, best]
            fine = value != -np.inf
            if not fine.any():
                break
            out.append((rows[fine] + at, best[fine], value[fine]))
            rounded[rows, best] = -np.inf
            s[rows, best] = -np.inf
        if out:
            row, col, value = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([a_ids.take(pa.array(row)), b_ids.take(pa.array(col)), pa.array(value)], ["id", "candidate_id", "similarity"])


def _same(own: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(row, columns) where the right side, which stands by id, has a row's own id."""
    low, high = np.searchsorted(others, own, "left"), np.searchsorted(others, own, "right")
    for r in np.flatnonzero(high > low):
        yield int(r), slice(int(low[r]), int(high[r]))


def within(vectors: DataFrame, key: str, group: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """group, a_id, b_id, similarity of every two vectors of a group, a_id < b_id, of at least `least` cosine."""
    rows = kept(_known(vectors, F.col(group), key, vector), "vectors")
    blocks = kept(_blocks(rows, "n", block), "vector-blocks")
    cells = blocks.agg(F.sum(F.expr("cast(n as long) * (n + 1) / 2"))).first()[0] or 0
    own = rows.join(blocks, ["g", "size"]).withColumn("own", _own("n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = own.select("g", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrow = pa.schema([pa.field("g", _arrow(rows, "g"))])
    found = partial(_cells, found=partial(_alike, least=least, kind=arrow.field("g").type, names=[group, "a_id", "b_id", "similarity"]))
    return _in_cells(dealt, int(cells)).mapInArrow(found, f"`{group}` {kinds['g']}, a_id {kinds['id']}, b_id {kinds['id']}, similarity double")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def nearest(asked: DataFrame, others: DataFrame, key: str, vector: str, k: int, least: float, group: str | None = None, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """id, candidate_id, similarity, rank: of every vector asked the k nearest others of its group (None: of all) of at least
    `least` cosine, by similarity rounded to `digits`, then by id. An id is one row of its side."""
    of = F.col(group) if group else F.lit(0)
    left, right = (kept(_known(df, of, key, vector), "vectors") for df in (asked, others))
    blocks = kept(_blocks(left, "n", block).join(_blocks(right, "m", block), ["g", "size"]), "vector-blocks")
    cells = blocks.agg(F.sum(F.expr("cast(n as long) * m"))).first()[0] or 0

    def dealt(rows: DataFrame, mine: str, theirs: str, side: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        i, j = (_own(mine), every) if side == 0 else (every, _own(mine))
        return rows.join(blocks, ["g", "size"]).select("g", "size", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "id", "v")

    return nearest_in_cells(dealt(left, "n", "m", 0).unionByName(dealt(right, "m", "n", 1)), int(cells), k, least, digits)


def nearest_in_cells(rows: DataFrame, cells: int, k: int, least: float, digits: int = 9) -> DataFrame:
    """id, candidate_id, similarity, rank: as nearest(), of rows (g, size, i, j, side, id, v) that stand in their cells."""
    kind = rows.schema["id"].dataType.simpleString()
    met = _in_cells(rows, cells).mapInArrow(partial(_cells, found=partial(_nearest, k=k, least=least, digits=digits)), f"id {kind}, candidate_id {kind}, similarity double")
    return top_n(met, ["id"], [F.round("similarity", digits).desc(), F.asc("candidate_id")], k)

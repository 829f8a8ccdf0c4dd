"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Fingerprints are taken over word shingles in Arrow batches, then made distinct; copies share one. Two fingerprints
that differ in at most 4 of 64 bits have a variant in common that is within half the radius of both. The plain ball of
half radius 2 has 2,081 variants per fingerprint, 16 times the input in shuffled bytes. So the ball is taken over
projections: with three blocks of bits, some pair of blocks holds at most 2 of the 4 differences, and over that pair
half the radius is 1. Every fingerprint emits the 131 variants of its three pairs of blocks, variants are shuffled and
sorted, and fingerprints that meet in a variant are verified on all 64 bits.

A variant's group is walked breadth first: what is linked leaves the rest, so that a group gives at most one link less
than it has members, never all its pairs, and no link between components is lost. A group of over `most` fingerprints is
not compared in a task: its members go through the plain ball of half radius 2, where any two in a group are linked and
a group has at most 2,081 members by geometry, so that a star per group is exact.

Components of links come from rounds of large-star and small-star, each written to the shared folder; two numbers per
round reach the driver. Before a round every task replaces its own edges, FLUSH at a time, by stars of what they connect;
where these are stars over the whole table, no round is left to do. Documents look up their fingerprint's component; fingerprints that many documents share are
few and broadcast in that join.

Defined results: null and empty texts have fingerprint zero and link like any other; null ids never are a component's
id unless it has no other; rows repeated in full share fingerprint and component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, join_hot, read, text_or_empty, written

BITS, RADIUS, SHINGLE, MOST, SEED = 64, 4, 4, 4096, 42
FLUSH = 500_000
BLOCKS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text in UTF-8: a bit is set if it is set in over half of the shingles' XXH64; a signed 64-bit number."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, n = b" ".join(words), len(words) - size + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins, ends = (ends - lengths)[:n].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        some = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[at : at + 65536], ends[at : at + 65536], strict=True)), "<u8", min(65536, n - at))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(frugal(partial(_fingerprints, shingle=shingle)), f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def projected_ball() -> list[tuple[int, int]]:
    """(mask, flip) of every variant: of each pair of blocks the projection and its one-bit variants.
    The lowest bit of the block left out tells pairs apart; a clash costs a comparison, not a link."""
    out = []
    for left_out in range(3):
        bits = [b for i, (lo, hi) in enumerate(BLOCKS) if i != left_out for b in range(lo, hi)]
        mask, tag = sum(1 << b for b in bits), 1 << BLOCKS[left_out][0]
        out += [(_signed(mask), _signed(flip ^ tag)) for flip in (0, *(1 << b for b in bits))]
    return out


def full_ball() -> list[tuple[int, int]]:
    """(mask, flip) of all variants within two bits."""
    singles = [1 << b for b in range(BITS)]
    return [(-1, _signed(x)) for x in (0, *singles, *(a | b for i, a in enumerate(singles) for b in singles[i + 1 :]))]


def variants(fps: DataFrame, ball: list[tuple[int, int]]) -> DataFrame:
    table = F.expr(f"array({','.join(f'struct({m}L as m, {x}L as x)' for m, x in ball)})".replace("-9223372036854775808L", "cast('-9223372036854775808' as bigint)"))
    return fps.select("fp", F.explode(table).alias("v")).select((F.col("fp").bitwiseAND(F.col("v.m"))).bitwiseXOR(F.col("v.x")).alias("variant"), "fp")


def differing(x: np.ndarray) -> np.ndarray:
    """Bits set in signed 64-bit numbers (of a negative number, bitwise_count counts the bits of its absolute value)."""
    return np.bitwise_count(x.view(np.uint64))


def spanning(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect what chains of links within fps connect."""
    a, b, front, rest = [], [], [], fps
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            continue
        x = front.pop()
        near = differing(rest ^ x) <= radius
        if near.any():
            hit = rest[near]
            a += [int(x)] * len(hit)
            b += hit.tolist()
            front += list(hit)
            rest = rest[~near]
    return a, b


def _links(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (variant, fp) -> (a, b): links; with b null: members of a group of over `most`."""
    kept_v, kept_f, wide = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(a, b, flagged) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*a, *flagged], pa.int64()), pa.array([*b, *[None] * len(flagged)], pa.int64())], ["a", "b"])

    def groups(v: np.ndarray, f: np.ndarray) -> tuple[list, list]:
        begin = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
        size = np.diff(np.r_[begin, len(v)])
        two = begin[size == 2]
        two = two[differing(f[two] ^ f[two + 1]) <= radius]
        a, b = f[two].tolist(), f[two + 1].tolist()
        for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            more = spanning(f[at : at + n], radius)
            a += more[0]
            b += more[1]
        return a, b

    for batch in batches:
        v, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        flagged: list = []
        if wide is not None:
            n = int(np.searchsorted(v, wide, "right"))
            flagged, v, f = f[:n].tolist(), v[n:], f[n:]
            if len(v):
                wide = None
        v, f = np.r_[kept_v, v], np.r_[kept_f, f]
        last = int(np.searchsorted(v, v[-1], "left")) if len(v) else 0
        a, b = groups(v[:last], f[:last])
        kept_v, kept_f = v[last:], f[last:]
        if len(kept_v) > most:
            wide, flagged = kept_v[0], flagged + kept_f.tolist()
            kept_v, kept_f = kept_v[:0], kept_f[:0]
        if a or flagged:
            yield out(a, b, flagged)
    a, b = groups(kept_v, kept_f)
    if a:
        yield out(a, b, [])


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Distinct (a, b), a < b, of linked fingerprints that connect all components; fps: a written table of distinct fp."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the ball is built for radii up to 4")
    met = variants(fps, projected_ball()).repartition("variant").sortWithinPartitions("variant")
    found = written(met.mapInArrow(frugal(partial(_links, radius=radius, most=most)), "a long, b long").distinct(), "simhash-links")
    pairs = found.filter("b is not null")
    wide = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if not wide.isEmpty():
        if radius < RADIUS:
            raise ValueError("groups too wide for a radius under 4: raise `most`")
        met = variants(wide, full_ball())
        # At most 2,081 fingerprints are within two bits of a variant, and any two of them are within four.
        stars = met.groupBy("variant").agg(F.collect_set("fp").alias("g")).filter("size(g) > 1").select(F.array_min("g").alias("a"), F.explode("g").alias("b"))
        pairs = pairs.union(stars.filter("a <> b").distinct())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> (node, smallest node that edges of the same batch of FLUSH connect it with)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= FLUSH:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) pairs -> node, root (the smallest node that is connected) of every node but roots."""

    def counted(edges: DataFrame) -> tuple:
        """Edges, and nodes that are neither a root nor a leaf of one edge. Every b is smaller than its a, so without
        such nodes each component is a star around its smallest node."""
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        return tuple(nodes.agg(F.sum("up"), F.count(F.when(F.col("up") * F.col("n") > 1, 1))).first())

    def folded(edges: DataFrame) -> DataFrame:
        return written(edges.mapInArrow(frugal(_contracted), "a long, b long").distinct(), "components")

    def star(edges: DataFrame, total: int) -> DataFrame:
        """edges (u, v) -> with the smallest of u and its neighbours as m."""
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return join_hot(edges, least.select("u", F.least("u", "m").alias("m"), "n"), ["u"], "n", max(1, total))

    now = folded(pairs.select("a", "b"))
    for _ in range(rounds):
        total, unsettled = counted(now)
        if not unsettled:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = written(star(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        lower = star(large, total).filter("u > v")  # large has at most as many rows as now
        joined = lower.select(F.col("u").alias("a"), F.col("m").alias("b")).union(lower.filter("v <> m").select("v", "m")).distinct()
        now = folded(joined)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    own = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "simhash-fps")
    roots = components(links(own.select("fp"), radius, most))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("k"))
    of_fp = join_hot(rooted, best, ["root"], "k", max(1, own.count())).select("fp", "n", "component_id")
    return join_hot(rows, written(of_fp, "simhash-components"), ["fp"], "n", max(1, rows.count())).select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")

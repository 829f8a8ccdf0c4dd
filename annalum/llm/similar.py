"""Near-duplicates by similarity: every pair of texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

Texts with equal sets are one node. Candidates come in three stages; whatever a stage proposes is verified on the
shingles themselves, so that no pair is linked that is not alike.

1. SimHash: fingerprints over the shingles that differ in at most 4 bits, by meet-in-the-middle ball hashing (simhash).
   Fingerprints alone cannot do it: at a Jaccard of 0.8 two of them differ in ten of 64 bits on average.
2. Heads: a set of n shingles stands in one order for all texts; two sets of that similarity share a shingle among the
   first n - ceil(0.8 n) + 1 of each. The order puts frequent shingles last, so that heads hold rare ones: first those
   that are frequent in a sample of texts, then those that are found in over CROWD heads of the whole table, for which
   the texts that hold them are read again. The order decides what is compared, never what is linked. Nodes that meet
   in a shingle of their heads are compared with one of them, picked by hash for every shingle.
3. What that has not connected is compared pair by pair within the groups of three and more that hold several
   components; a pair has a node outside the group's largest component. Groups are cut into blocks of about CELL nodes,
   and pairs of blocks are dealt like keys. This makes the result exact.

Pairs are dropped by exact bounds first: by size, then by parity bits of each set, two and more a shingle, of which at
most as many differ as the sets do. Emitted rows grow with the groups in stages 1 and 2 and with what the bounds leave
in stage 3; the comparisons of stage 3 grow with the square of a group that is not alike and whose texts consist of
frequent passages for the most part, over n / 4 bytes a node. Shingles are told apart by 64 bits of XXH64.

Defined results: null texts and texts without words are alike; a text of under five words is one shingle; null ids
connect others but are no component's id unless it has no other; an empty table gives an empty result. Of a component
whose rows all lack an id one row stays; rows that share id and component are one document and stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, join_hot, small, text_or_empty, written
from annalum.llm.simhash import components, links

#: Similarity NUM / DEN; Jaccard i / (x + y - i) >= NUM / DEN is i * (NUM + DEN) >= NUM * (x + y).
SHINGLE, NUM, DEN, SEED = 5, 4, 5, 42
LEAST_BITS, SAMPLE, FREQUENT, MOST_FREQUENT, BLOCK, SLICE = 1024, 10_000, 4, 100_000, 1024, 128
CROWD, GUARDS, CELL = 4096, 3, 512


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of a UTF-8 text's shingles, ascending."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    size = min(width, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(n if size else 1)), np.uint64))


def parity(found: np.ndarray) -> np.ndarray:
    """Parity of how many shingles fall on each bit, over at least two bits a shingle, as 64-bit numbers. Of half the
    width it is the exclusive or of its halves."""
    width = max(LEAST_BITS, 1 << (2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(found: np.ndarray) -> int:
    """SimHash of distinct shingles: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        some = found[at : at + 65536].astype("<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def head(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all texts; frequent: ascending, with their ranks."""
    rank = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, ranks[at], 0)
    n = len(found)
    return found[np.lexsort((found, rank))[: n - -(-NUM * n // DEN) + 1]]


def _node(found: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with the shingles of their last column, so that a batch's shingles are never all in memory."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            yield batch, [shingles(t.as_buffer().to_pybytes()) for t in batch.column(batch.num_columns - 1)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values, pa.int64()))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _each(batches):
        for found in sets:
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], ["h"])


def _heads(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, sets in _each(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), _lists([head(s, frequent, ranks) for s in sets]), _lists([parity(s) for s in sets])],
            ["doc_id", "text_hash", "node", "fp", "n", "head", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "shingles"])


def _column(c: pa.Array) -> np.ndarray:
    """Numbers, or for lists their numbers as an array each."""
    if not pa.types.is_list(c.type):
        return c.to_numpy()
    out, values, ends = np.empty(len(c), object), c.values.to_numpy(), c.offsets.to_numpy()
    for i in range(len(c)):
        out[i] = values[ends[i] : ends[i + 1]]
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sorted batches -> (starts, columns) of whole groups of equal first column; a group may span batches."""
    kept: list[list[np.ndarray]] = []

    def whole(cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]), cols

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_column(c) for c in batch.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last or (kept and kept[0][0][0] != cols[0][0]):
            done = [*kept, [c[:last] for c in cols]]
            yield whole([np.concatenate(c) for c in zip(*done, strict=True)])
            kept = []
        kept.append([c[last:] for c in cols])
    if kept:
        yield whole([np.concatenate(c) for c in zip(*kept, strict=True)])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (token, node, n) -> (null, centre, other) of every group, and (token, node, null) of groups of over two.
    A group's first node is its centre. The first two rows of a group that goes on in the next batch are put before it,
    so no group is held as a whole; what they give twice counts once later."""
    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if len(held[0]) and held[0][0] == cols[0][0]:
            cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)]
        token, node, n = cols
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        held = [c[starts[-1] : starts[-1] + 2].copy() for c in cols]
        size = np.diff(np.r_[starts, len(token)])
        centre, of_many = np.repeat(starts, size), np.repeat(size, size) > 2
        other = (centre != np.arange(len(token))) & (DEN * np.minimum(n, n[centre]) >= NUM * np.maximum(n, n[centre]))
        a, b, k = node[centre[other]], node[other], int(of_many.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(token[of_many], pa.int64())]), pa.array(np.r_[np.minimum(a, b), node[of_many]], pa.int64()), pa.concat_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.nulls(k, pa.int64())])],
            ["token", "a", "b"])


def close_pairs(root: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) of different roots that the bounds leave. Sizes differ by a quarter at most, so widths by one doubling.
    Nodes of one side are not compared, but for side -1. One of a pair is outside the largest root."""
    roots, members = np.unique(root, return_counts=True)
    major = root == roots[members.argmax()]
    width = np.array([len(b) for b in bits])

    def near(i: int, row: np.ndarray, js: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(js), BLOCK):
            j = js[at : at + BLOCK]
            ok = (root[j] != root[i]) & ((side[j] != side[i]) | (side[j] < 0)) & (DEN * np.minimum(n[j], n[i]) >= NUM * np.maximum(n[j], n[i]))
            j = j[ok]
            if len(j):
                differ = np.bitwise_count((rows[at : at + BLOCK][ok] ^ row).view(np.uint64)).sum(1, dtype=np.int64)
                j = j[differ * (NUM + DEN) <= (DEN - NUM) * (n[j] + n[i])]
                if len(j):
                    yield i, j

    for w in np.unique(width).tolist():
        own, twice = (np.flatnonzero(width == x) for x in (w, 2 * w))
        own, twice = own[np.argsort(major[own], kind="stable")], twice[np.argsort(major[twice], kind="stable")]  # the largest root comes last
        rows = np.stack(bits[own])
        few = int((~major[own]).sum())
        for i in range(few):
            yield from near(own[i], rows[i], own[i + 1 :], rows[i + 1 :])
        if len(twice):
            folded = np.stack([b[:w] ^ b[w:] for b in bits[twice]])
            for i in range(few):
                yield from near(own[i], rows[i], twice, folded)
            for i in range(int((~major[twice]).sum())):
                yield from near(twice[i], folded[i], own[few:], rows[few:])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, node, root, n, side, bits) -> pairs of different roots that the bounds leave, each once a batch."""
    for starts, (_, node, root, n, side, bits) in groups(batches):
        found = set()
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            own = node[lo:hi]
            for i, js in close_pairs(root[lo:hi], n[lo:hi], bits[lo:hi], side[lo:hi]):
                found |= {(min(own[i], x), max(own[i], x)) for x in own[js].tolist()}
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def cells(many: DataFrame, cell: int = CELL) -> DataFrame:
    """cell, node, root, side of (token, node, root) for tokens of several roots: the groups to compare pair by pair.

    A pair has a node outside the token's largest root. So the members of that root lie in one cell for each block of
    the others, mostly once, and the others meet each other in a triangle of their blocks. A block holds about `cell`."""
    by_root = many.groupBy("token", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("token").agg(F.sum("n").alias("k"), F.max(F.struct("n", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1")
    blocks = lambda n: F.ceil(n / cell).cast("int")
    sizes = written(sizes.select("token", "k", F.col("major.root").alias("major"), blocks(F.col("major.n")).alias("rows"), blocks(F.col("k") - F.col("major.n")).alias("others")), "similar-several")
    met = join_hot(many, sizes, ["token"], "k", max(1, sizes.agg(F.sum("k")).first()[0] or 0)).filter("major is not null")
    met = written(met.select("token", "node", "root", "major", "rows", "others"), "similar-several-met")
    block = lambda n: F.pmod(F.xxhash64("node", "token"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_major = met.filter("root = major").withColumn("i", block(F.col("rows"))).withColumn("j", each("others"))
    outside = met.filter("root <> major").withColumn("own", block(F.col("others")))
    across = outside.withColumn("i", each("rows"))
    among = outside.withColumn("other", each("others"))

    def dealt(df: DataFrame, kind: int, i: str, j: str, side: Column) -> DataFrame:
        return df.select(F.xxhash64("token", F.lit(kind), F.expr(i), F.expr(j)).alias("cell"), "node", "root", side.cast("long").alias("side"))

    rectangle = dealt(in_major, 0, "i", "j", F.lit(0)).unionByName(dealt(across, 0, "i", "own", F.lit(1)))
    return rectangle.unionByName(dealt(among, 1, "least(own, other)", "greatest(own, other)", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct (a, b): those of the similarity. Bounds first; only texts of what is left are cut into shingles again."""

    def side(c: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))

    def folded(c: str, other: str) -> Column:
        part = f"cast(size({c}) div 2 as int)"
        return F.when(F.size(c) > F.size(other), F.expr(f"zip_with(slice({c}, 1, {part}), slice({c}, {part} + 1, {part}), (x, y) -> x ^ y)")).otherwise(F.col(c))

    both, alike = F.col("a_n") + F.col("b_n"), DEN * F.least("a_n", "b_n") >= NUM * F.greatest("a_n", "b_n")
    differ = F.aggregate(F.zip_with(folded("a_bits", "b_bits"), folded("b_bits", "a_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = pairs.join(side("a"), "a").join(side("b"), "b").filter(alike & (differ * (NUM + DEN) <= (DEN - NUM) * both))
    left = written(left.select("a", "b", "a_n", "b_n"), "similar-left")
    ids = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    wanted = written(nodes.join(ids, "node", "left_semi").select("text_hash"), "similar-wanted")
    sets = texts.join(small(wanted), "text_hash", "left_semi").select("text").mapInArrow(frugal(_sets), "node long, shingles array<long>").dropDuplicates(["node"])
    sets = written(sets, "similar-sets")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    met = left.join(of("a"), "a").join(of("b"), "b").filter(shared * (NUM + DEN) >= NUM * both)
    return written(met.select("a", "b"), "similar-links")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are close: a star for each fingerprint and a pair for each link of two."""
    centres = written(nodes.groupBy("fp").agg(F.min("node").alias("centre"), F.count("*").alias("k")), "similar-fps")
    same = join_hot(nodes.select("node", "fp"), centres, ["fp"], "k", max(1, nodes.count())).filter("node <> centre")
    of = lambda c: centres.select(F.col("fp").alias(c), F.col("centre").alias(f"{c}_node"))
    near = links(centres.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.select(F.col("centre").alias("a"), F.col("node").alias("b")).union(near.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node")))


def text_hash() -> Column:
    return F.xxhash64(text_or_empty().cast("binary"))


def _headed(texts: DataFrame, frequent: dict[int, int]) -> DataFrame:
    """doc_id, text_hash, node, fp, n, head, bits of every row; frequent: shingles that come last, with their ranks."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    order = sorted(frequent.items())
    shingle, ranks = np.array([h for h, _ in order], np.uint64), np.array([k for _, k in order], np.int64)
    schema = f"doc_id {kind}, text_hash long, node long, fp long, n long, head array<long>, bits array<long>"
    return texts.mapInArrow(frugal(partial(_heads, frequent=shingle, ranks=ranks)), schema)


def _met(nodes: DataFrame) -> DataFrame:
    tokens = nodes.select(F.explode("head").alias("token"), "node", "n").repartition("token").sortWithinPartitions("token", F.xxhash64("token", "node"))
    return written(tokens.mapInArrow(frugal(_stars), "token long, a long, b long"), "similar-met")


def _most(counts: DataFrame, least: int) -> dict[int, int]:
    """The most frequent of (h, k), MOST_FREQUENT at most."""
    rows = counts.filter(F.col("k") >= least).orderBy(F.desc("k"), "h").limit(MOST_FREQUENT).collect()
    return {r.h % (1 << 64): r.k for r in rows}


def _uncrowded(nodes: DataFrame, met: DataFrame, texts: DataFrame, frequent: dict[int, int], every: int) -> tuple[DataFrame, DataFrame]:
    """nodes and met after shingles that crowd heads, and that the sample did not show, have gone to the end of the order.

    Heads without such a shingle stay as they are, so only texts with one are read again, once to count what else they
    share and once for their new heads."""

    def of(ids: DataFrame) -> DataFrame:
        wanted = written(nodes.join(ids, "node", "left_semi").select("text_hash"), "similar-wanted")
        return texts.join(small(wanted), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("doc_id", "text_hash", "text")

    for _ in range(GUARDS):
        counts = met.filter("token is not null").groupBy(F.col("token").alias("h")).agg(F.count("*").alias("k"))
        crowded = {h: k for h, k in _most(counts, CROWD + 1).items() if h not in frequent}
        if not crowded:
            break
        signed = lambda found: texts.sparkSession.createDataFrame([(h - (1 << 64) if h >> 63 else h,) for h in found], "token long")
        holders = lambda found: nodes.select("node", F.explode("head").alias("token")).join(F.broadcast(signed(found)), "token").select("node").distinct()
        shared = of(holders(crowded)).select("text").mapInArrow(frugal(_sampled), "h long").groupBy("h").agg(F.count("*").alias("k"))
        new = {h: max(1, k // every) for h, k in _most(shared, CROWD + 1).items() if h not in frequent} or dict.fromkeys(crowded, 1)
        frequent = frequent | new
        again = written(holders(new), "similar-again")
        heads = _headed(of(again), frequent).drop("doc_id").dropDuplicates(["node"]).select(*nodes.columns)
        nodes = written(nodes.join(small(again), "node", "left_anti").unionByName(heads), "similar-nodes")
        met = _met(nodes)
    return nodes, met


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root, component_id of every row of docs."""
    texts = docs.select("doc_id", text_hash().alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    every = max(1, docs.count() // SAMPLE)
    some = texts.filter(F.pmod("text_hash", F.lit(every)) == 0).select("text").mapInArrow(frugal(_sampled), "h long")
    frequent = _most(some.groupBy("h").agg(F.count("*").alias("k")), FREQUENT)
    rows = written(_headed(texts, frequent), "similar-rows")
    nodes = written(rows.drop("doc_id").dropDuplicates(["node"]), "similar-nodes")
    nodes, met = _uncrowded(nodes, _met(nodes), texts, frequent, every)

    # Pairs and roots are written before more is joined: the driver plans a query again after each of its stages, so a few
    # plans of some joins take less of its memory than one of all.
    pairs = written(met.filter("token is null").select("a", "b").union(simhash_pairs(nodes)).distinct(), "similar-pairs")
    first = _verified(pairs, nodes, texts)
    roots = components(first)
    rooted = written(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "similar-rooted")
    many = met.filter("token is not null").select("token", F.col("a").alias("node")).join(rooted, "node")
    apart = cells(many).join(nodes.select("node", "n", "bits"), "node")
    apart = apart.select("cell", "node", "root", "n", "side", "bits").repartition("cell").sortWithinPartitions("cell")
    second = _verified(written(apart.mapInArrow(frugal(_apart), "a long, b long").distinct(), "similar-apart"), nodes, texts)

    roots = components(roots.toDF("a", "b").union(second))  # the roots connect what the first links do
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    own = written(own.join(roots, "node", "left").select("node", "n", "least_id", F.coalesce("root", "node").alias("root")), "similar-own")
    best = own.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("k"))
    of_node = join_hot(own, best, ["root"], "k", max(1, own.count())).select("node", "n", "root", "component_id")
    placed = join_hot(rows.select("doc_id", "text_hash", "node"), written(of_node, "similar-components"), ["node"], "n", max(1, rows.count()))
    return placed.select("doc_id", "text_hash", "root", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs."""
    return _placed(docs).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest id."""
    found, name = written(_placed(docs), "similar-found"), "_similar"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    here, text, doc_id = docs.withColumn(f"{name}_hash", text_hash()), f"{name}_text", f"{name}_id"
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text)).distinct()
    same = (F.col("doc_id") == F.col(doc_id)) & (F.col(f"{name}_hash") == F.col(text))
    named = here.filter("doc_id is not null").join(small(gone), same, "left_anti").select(*docs.columns)
    nameless = found.filter("doc_id is null")
    if nameless.isEmpty():
        return named
    stay = nameless.filter("component_id is null").groupBy("root").agg(F.min("text_hash").alias(text)).select(text)
    kept = here.filter("doc_id is null").join(small(stay), F.col(f"{name}_hash") == F.col(text), "left_semi").dropDuplicates([f"{name}_hash"])
    return named.unionByName(kept.select(*docs.columns))

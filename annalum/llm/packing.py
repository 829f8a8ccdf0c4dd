"""Best-fit packing of documents into sequences of a fixed number of tokens.

Texts are tokenised once, in Arrow batches. A document longer than a sequence is cut into full pieces, the first of
which takes the rest and so may be shorter; all other documents stay whole. Full pieces are sequences of their own.

The rest is packed online with bounded space: a fixed number of open bins, listed by free space, and a bitset with
one bit per free space in use. A piece goes, in the order of arrival, to the bin with the least free space that holds
it, found by one shift and one lowest-bit step. When too many bins are open, the fullest closes. At the end of a task
the bins still open are merged by the same rule, the largest first. Tasks see pieces in the order of a hash, so that
every task gets large and small ones. Only ids and lengths are shuffled, never texts. A task holds its open bins.

Tokens: words of the vocabulary's own pattern are looked up in a bounded memo per worker; others are encoded by
tiktoken with the ranks of the same vocabulary, which gives the ids of the tokenizers file (the tests compare them).
A text that spells a special token is encoded by tokenizers as a whole, for there the two differ.

Defined results: null and empty texts are one piece, the end token; rows repeated in full are packed twice; null ids
are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, read, text_or_empty, written

CAPACITY, END, OPEN_BINS, PIECES_PER_TASK = 1024, 2, 256, 100_000
VOCABULARY, RANKS, MEMO = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 100_000


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def special_tokens(json_file: str) -> list[str]:
    """The added tokens of a tokenizers file, which lists them before its vocabulary."""
    with open(json_file, encoding="utf-8") as f:
        begun = ""
        while (at := begun.find('"added_tokens"')) < 0 or "]" not in begun[at:]:
            more = f.read(1 << 16)
            if not more:
                return []
            begun += more
    found, _ = json.JSONDecoder().raw_decode(begun[begun.index("[", at) :])
    return [t["content"] for t in found]


def encoder(files: tuple[str, str] | None = None) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian unsigned 32-bit numbers."""
    import base64
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken

    json_file, ranks_file = files or vocabulary_files()
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = special_tokens(json_file)
    memo: dict[str, bytes] = {}
    whole = None

    def fresh(part: str) -> bytes:
        if len(memo) >= MEMO:
            memo.clear()
        ids = np.array(words.encode_ordinary(part), np.uint32).tobytes()
        if len(part) < 64:
            memo[part] = ids
        return ids

    def encode(text: str) -> bytes:
        nonlocal whole
        if any(s in text for s in special):
            if whole is None:  # few texts need it
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(json_file)
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        # Before a blank that a visible character follows, the pattern always begins a new match.
        first, *rest = text.split(" ")
        parts = [first]
        for word in rest:
            if word and not word[0].isspace():
                parts.append(" " + word)
            else:
                parts[-1] += " " + word
        get = memo.get
        return b"".join([get(p) or fresh(p) for p in parts if p])

    return encode


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    start = n % capacity or min(n, capacity)
    if start:
        yield 0, start
    while start < n:
        yield start, capacity
        start += capacity


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end: int, files, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, stop = encoder(files), np.array([end], np.uint32).tobytes()
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + stop
            for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                for col, value in zip(out, (doc_id, piece, start, length, zlib.crc32(own), own if with_ids else None), strict=True):
                    col.append(value)
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files=None, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of every document's pieces; with_ids=False leaves ids null."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(partial(_pieces, capacity=capacity, end=end, files=files, with_ids=with_ids)), schema)


class Bins:
    """Open bins by free space. close(rows of a bin) is called once for each."""

    def __init__(self, capacity: int, most: int, close: Callable[[list], None]):
        self.capacity, self.most, self.close = capacity, most, close
        self.by_free: list[list] = [[] for _ in range(capacity + 1)]
        self.bits = self.n = 0

    def _take(self, free: int) -> list:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n -= 1
        return found

    def add(self, items: list, length: int) -> None:
        """items: (row, length) pairs that stay together."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            into = self._take(free)
            into += items
        else:
            free, into = self.capacity, items
        free -= length
        if not free:
            return self.close(into)
        self.by_free[free].append(into)
        self.bits |= 1 << free
        self.n += 1
        if self.n > self.most:
            self.close(self._take((self.bits & -self.bits).bit_length() - 1))
        return None

    def finish(self) -> None:
        left = sorted(((self.capacity - free, b) for free in range(self.capacity + 1) for b in self.by_free[free]), key=lambda x: -x[0])
        last = Bins(self.capacity, len(left) + 1, self.close)
        for filled, items in left:
            last.add(items, filled)
        for free in range(self.capacity + 1):
            for b in last.by_free[free]:
                self.close(b)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    base, made, done = TaskContext.get().partitionId() << 40, 0, []

    def close(items: list) -> None:
        nonlocal made
        offset = 0
        for row, length in items:
            done.append((*row, base + made, offset))
            offset += length
        made += 1

    def out(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = [*(f.type for f in schema), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*schema.names, "sequence_id", "offset"])

    bins, schema = Bins(capacity, open_bins, close), None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[3] == capacity:
                close([(row, capacity)])
            else:
                bins.add([(row, row[3])], row[3])
        if done:
            yield out(schema)
    bins.finish()
    if done:
        yield out(schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """parts (a written table of pieces) with sequence_id and offset."""
    parts = parts.select("doc_id", "piece", "start", "length", "ids_crc32")
    tasks = max(1, parts.count() // pieces_per_task)
    dealt = parts.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(tasks, "h").sortWithinPartitions("h", "doc_id", "piece").drop("h")
    schema = dealt.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    return dealt.mapInArrow(frugal(partial(_pack, capacity=capacity, open_bins=open_bins)), schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files=None, open_bins: int = OPEN_BINS) -> DataFrame:
    """The placement of every piece. Token ids of pieces come from pieces(); they join on (doc_id, piece)."""
    return pack(written(pieces(docs, capacity, end, files, with_ids=False).drop("ids"), "packing-pieces"), capacity, open_bins)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents").select("doc_id", "text"))

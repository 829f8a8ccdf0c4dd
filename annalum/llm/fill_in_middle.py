"""Fill-in-middle by succinct rank and select.

The texts of a slice of a batch lie end to end in UTF-8. A bitvector has a one where a code point starts and a one
behind the last byte; it is packed into 64-bit words, and a directory holds how many ones precede every block of words.
Popcounts between a text's first and last byte give its n, and select on the ranks of its two cuts gives the bytes to
cut at, so no text is decoded and no list of code points is made. A slice holds SLICE bytes or one longer text, its
bitvector an eighth of that.

Draws come from a hash of the document's id, in columns: two cuts, plain or not, and which of the two orders.

Defined results: a null text is empty; an empty text, or one that holds a marker, stays plain; a null id draws as if
it were empty text; rows repeated in full get the same output; an empty table gives an empty result; other columns are
ignored. A text that is not UTF-8 is cut between its bytes that are not continuations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, read, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SPM, SALT = 90, 20, "1:"
BLOCK, SLICE = 8, 8 << 20


class Boundaries:
    """Rank and select over the code points that start in data, and one more behind it."""

    def __init__(self, data: np.ndarray):
        ones = np.ones(-(-(len(data) + 1) // (64 * BLOCK)) * 64 * BLOCK, bool)
        np.not_equal(data & 0xC0, 0x80, out=ones[: len(data)])
        ones[len(data) + 1 :] = False
        self.words = np.packbits(ones, bitorder="little").view("<u8").reshape(-1, BLOCK)
        self.directory = np.r_[0, np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each position."""
        block, inside = np.divmod(at, 64 * BLOCK)
        word, bit = np.divmod(inside, 64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64)
        before = (counts * (np.arange(BLOCK) < word[:, None])).sum(1)
        below = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        return self.directory[block] + before + np.bitwise_count(self.words[block, word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the one that has k ones before it."""
        block = np.searchsorted(self.directory, k, "right") - 1
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        k = k - self.directory[block]
        word = (upto <= k[:, None]).sum(1)
        k = k - np.where(word > 0, upto[np.arange(len(k)), word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= k[:, None]).sum(1)
        return (block * BLOCK + word) * 64 + bit


def cuts(texts: list, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: n, the code points before the smaller and the larger cut, and the bytes before them."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = np.r_[0, ends[:-1]]
    found = Boundaries(np.frombuffer(b"".join(texts), np.uint8))
    first = found.rank(begins)
    n = found.rank(ends) - first
    low, high = one % (n + 1), other % (n + 1)
    low, high = np.minimum(low, high), np.maximum(low, high)
    a, b = (np.minimum(found.select(first + k), ends) - begins for k in (low, high))
    return n, low, high, a, b


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > SLICE:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _transformed(batches: Iterator[pa.RecordBatch], markers: tuple[bytes, bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, one, other, form) -> (doc_id, n, form, prefix_chars, middle_chars, output)."""
    p, s, m = markers
    for whole in batches:
        for begin, end in _slices(pa.compute.binary_length(whole.column(1)).to_pylist()):
            batch = whole.slice(begin, end - begin)
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            n, low, high, a, b = cuts(texts, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            forms, prefix, middle, output = [], [], [], []
            for text, form, i, j, x, y in zip(texts, batch.column(4).to_pylist(), low.tolist(), high.tolist(), a.tolist(), b.tolist(), strict=True):
                if form == "plain" or not text or any(marker in text for marker in markers):
                    form, made = "plain", text
                elif form == "psm":
                    made = b"".join((p, text[:x], s, text[y:], m, text[x:y]))
                else:
                    made = b"".join((s, text[y:], p, text[:x], m, text[x:y]))
                plain = form == "plain"
                forms.append(form)
                prefix.append(None if plain else i)
                middle.append(None if plain else j - i)
                output.append(made)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, changed: int = CHANGED, spm: int = SPM, salt: str = SALT, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text to train on) of every row of docs; changed and spm
    are percentages: of documents that are not plain, and of those in the order suffix, prefix, middle."""
    one, other, third, fourth = draws(F.col("doc_id"), salt)
    form = F.when(third % 100 >= changed, "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), one.alias("one"), other.alias("other"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(frugal(partial(_transformed, markers=tuple(x.encode() for x in markers))), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from. Texts that hold a marker are plain, so each marker is found once."""
    p, s, m = (rf"\Q{x}\E" for x in markers)
    psm = F.split(output.substr(F.lit(len(markers[0]) + 1), F.length(output)), f"{s}|{m}")
    spm = F.split(output.substr(F.lit(len(markers[1]) + 1), F.length(output)), f"{p}|{m}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CHANGED} THEN 'plain'
                  WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
                          WHEN 'psm' THEN '{PREFIX}' || substr(t, 1, a) || '{SUFFIX}' || substr(t, b + 1) || '{MIDDLE}' || substr(t, a + 1, b - a)
                          ELSE '{SUFFIX}' || substr(t, b + 1) || '{PREFIX}' || substr(t, 1, a) || '{MIDDLE}' || substr(t, a + 1, b - a) END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

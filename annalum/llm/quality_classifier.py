"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of scores.

A document's strength is linear in a few dozen features of its whole text (shares of kinds of characters, lengths and
variety of words, repetition of phrases and lines), standardised, with squares. The model is learned from preference
pairs: a good document beats a bad one with probability sigmoid(strength difference), fitted by Newton's method on the
logistic loss of feature differences. Labels give the pairs. The cut is the quantile of strengths that leaves as large
a share below as the labels call bad; score = sigmoid(strength - cut).

Fitting takes every labelled row and every pair of a good and a bad one. Of a pair only the difference of two strengths
counts, so pairs are summed by bins of strength: a bin keeps the sums of features times the powers of the distance to its
middle, and a series of ORDER terms about the middles gives the sums over all pairs of two bins, to eleven digits or so.
A round of Newton's method reads the table of features twice, in TASKS tasks, whatever the number of pairs; the driver
holds sums by bin. The cut is exact, by counts in ranges that shrink. Scoring reads every row in Arrow batches.

Defined results: null and empty texts are scored by the features of the empty text; several labels of a document are
averaged; null labels and ids are not learned from; without labels of both kinds every score is 0.5; an empty table
gives an empty result; rows repeated in full score alike; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, held_out, read, small, text_or_empty, written

FIT_ROWS, STEP, RIDGE, SEED = 20_000, 4096, 1e-3, 11
BIN, ORDER, TASKS, RANGES, FEW, FAR = 0.25, 10, 32, 1024, 4096, 500.0
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#*$%&|<>", b"()[]{}", b"'\"", b"/\\@_=+~^`-", bytes(range(128, 256)))


def features(text: bytes) -> list[float]:
    """Of a whole text in UTF-8."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [float(counts[list(kind)].sum()) / n for kind in KINDS]
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    grams = len(words) - 3
    distinct = len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / grams if grams > 0 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    return [
        *shares, np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(seen) / m, max(seen.values(), default=0) / m, 1.0 - distinct,
        1.0 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)), sum(c for b, c in ends.items() if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122) / m, sum(1 for w in words if w.isupper()) / m, sum(1 for w in words if len(w) == 1) / m]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut, -500, 500)))


#: Rows of features and labels, a few at a time; and what gives such rows to a function, part by part of a table.
Rows = Iterator[tuple[np.ndarray, np.ndarray]]
Over = Callable[[Callable[[Rows], object]], list]


def _shape(rows: Rows) -> tuple:
    """How many rows, how many bad ones, mean of features, sum of squares about it."""
    n, bad, mean, square = 0, 0, 0.0, 0.0
    for x, good in rows:
        k, own = len(x), x.mean(0)
        square = square + ((x - own) ** 2).sum(0) + (own - mean) ** 2 * (n * k / (n + k))
        mean = mean + (own - mean) * (k / (n + k))
        n, bad = n + k, bad + int((good == 0).sum())
    return n, bad, mean, square


def _binned(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.rint(s / BIN).astype(np.int64)
    return at, s - at * BIN


def _moments(rows: Rows, model: Model) -> dict[tuple[int, int], np.ndarray]:
    """(label, bin): for each power the sum of power over factorial, and of that times the features."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for x, good in rows:
        z = model.expand(x)
        at, off = _binned(np.clip(z @ model.weights, -FAR, FAR))
        order = np.lexsort((at, good))
        at, good, z = at[order], good[order], np.hstack([np.ones((len(z), 1)), z[order]])
        off = np.where(good == 1, -off[order], off[order])  # strengths of good rows are subtracted
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (good[1:] != good[:-1])])
        sums = np.stack([np.add.reduceat(z * (off**a / math.factorial(a))[:, None], starts) for a in range(ORDER)], 1)
        for k, own in zip(starts, sums, strict=True):
            key = int(good[k]), int(at[k])
            found[key] = found.get(key, 0.0) + own
    return found


def _own_curve(rows: Rows, model: Model, series: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The sum of z z' times the weight of a row in all its pairs, which is a series by its bin."""
    total = 0.0
    for x, good in rows:
        z = model.expand(x)
        at, off = _binned(np.clip(z @ model.weights, -FAR, FAR))
        off = np.where(good == 1, -off, off)
        terms = np.array([series[int(g), int(k)] for g, k in zip(good, at, strict=True)])
        weight = sum(terms[:, a] * off**a / math.factorial(a) for a in range(ORDER))
        total = total + (z * weight[:, None]).T @ z
    return total


def _sigmoid_slopes(x: np.ndarray) -> list[np.ndarray]:
    """The sigmoid and its derivatives, as polynomials in the sigmoid."""
    t, out, poly = 1 / (1 + np.exp(-np.clip(x, -500, 500))), [], np.polynomial.Polynomial([0.0, 1.0])
    for _ in range(ORDER + 1):
        out.append(poly(t))
        poly = poly.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
    return out


def _over_pairs(sums: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict]:
    """Slope and mixed part of the curve over all pairs of a good and a bad row; the series of _own_curve()."""
    bins = {g: sorted(k for label, k in sums if label == g) for g in (0, 1)}
    good, bad = (np.stack([sums[g, k] for k in bins[g]]) for g in (1, 0))  # bin, power, 1 and features
    d = _sigmoid_slopes(BIN * (np.array(bins[0])[:, None] - np.array(bins[1])[None, :]))  # bad - good
    width = good.shape[2] - 1
    slope, mixed = np.zeros(width), np.zeros((width, width))
    series = {1: np.zeros((len(good), ORDER)), 0: np.zeros((len(bad), ORDER))}
    for a in range(ORDER):
        for b in range(ORDER - a):
            p, w = d[a + b], d[a + b + 1]
            slope += (bad[:, a, 0] @ p) @ good[:, b, 1:] - (p @ good[:, b, 0]) @ bad[:, a, 1:]
            mixed += good[:, b, 1:].T @ (w.T @ bad[:, a, 1:])
            series[1][:, b] += bad[:, a, 0] @ w
            series[0][:, a] += w @ good[:, b, 0]
    return slope, mixed, {(g, k): row for g in (0, 1) for k, row in zip(bins[g], series[g], strict=True)}


def _counted(rows: Rows, model: Model, low: float, high: float) -> np.ndarray:
    """How many strengths are below low, and in each of RANGES parts of low to high."""
    total = np.zeros(RANGES + 1, np.int64)
    for x, _ in rows:
        s = model.strength(x)
        total[0] += int((s < low).sum())
        own = s[(s >= low) & (s <= high)]
        total[1:] += np.bincount(np.minimum((own - low) / (high - low) * RANGES, RANGES - 1).astype(int), minlength=RANGES)
    return total


def _strengths(rows: Rows, model: Model, low: float, high: float) -> np.ndarray:
    """The strengths from low to high."""
    return np.concatenate([np.empty(0), *[s[(s >= low) & (s <= high)] for s in (model.strength(x) for x, _ in rows)]])


def _ranked(over: Over, model: Model, rank: int) -> float:
    """The strength of that rank, from 0, among all rows."""
    low, high = (f(x) for f, x in zip((min, max), zip(*over(partial(_ends, model=model)), strict=True), strict=True))
    while low < high:
        counts = sum(over(partial(_counted, model=model, low=low, high=high)))
        before = np.cumsum(counts)
        part = int(np.searchsorted(before[1:], rank, "right"))
        wide = (high - low) / RANGES
        # A little more than the part, as its rows were told by a division.
        a, b = max(low, low + part * wide - wide / 8), min(high, low + (part + 1) * wide + wide / 8)
        if counts[1 + part] <= FEW or (a, b) == (low, high) or wide < 1e-13 * max(abs(low), abs(high), 1e-3):
            inside = np.sort(np.concatenate(over(partial(_strengths, model=model, low=a, high=b))))
            below = sum(over(partial(_below, model=model, low=a)))
            return float(inside[rank - below])
        low, high = a, b
    return float(low)


def _ends(rows: Rows, model: Model) -> tuple[float, float]:
    low, high = math.inf, -math.inf
    for x, _ in rows:
        s = model.strength(x)
        low, high = min(low, float(s.min())), max(high, float(s.max()))
    return low, high


def _below(rows: Rows, model: Model, low: float) -> int:
    return sum(int((model.strength(x) < low).sum()) for x, _ in rows)


def _nothing() -> Model:
    width = len(features(b""))
    return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)


def fit_over(over: Over, ridge: float = RIDGE) -> Model:
    """A model of all pairs of a good and a bad row of what `over` reads, whose parts have rows."""
    n, bad, mean, square = 0, 0, 0.0, 0.0
    for k, own_bad, own, own_square in over(_shape):
        square = square + own_square + (own - mean) ** 2 * (n * k / (n + k))
        mean, n, bad = mean + (own - mean) * (k / (n + k)), n + k, bad + own_bad
    if not 0 < bad < n:
        return _nothing()
    scale = np.sqrt(square / n)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * len(mean)), 0.0)
    pairs = float(bad) * (n - bad)
    for _ in range(25):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in over(partial(_moments, model=model)):
            for key, own in part.items():
                sums[key] = sums.get(key, 0.0) + own
        slope, mixed, series = _over_pairs(sums)
        curve = sum(over(partial(_own_curve, model=model, series=series))) - mixed - mixed.T
        w = model.weights
        step = np.linalg.solve(curve / pairs + ridge * np.eye(len(w)), slope / pairs - ridge * w)
        model = Model(model.mean, model.scale, w + step, 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.mean, model.scale, model.weights, (_ranked(over, model, bad - 1) + _ranked(over, model, bad)) / 2)


def fit(x: np.ndarray, good: np.ndarray, pairs: int | None = None, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """x: features, good: 0 or 1. All pairs; with `pairs`, so many drawn ones."""
    if not len(x) or good.min() == good.max():
        return _nothing()
    if pairs is None:
        return fit_over(lambda task: [task((x[at : at + STEP], good[at : at + STEP]) for at in range(0, len(x), STEP))], ridge)
    scale = x.std(0)
    model = Model(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * x.shape[1]), 0.0)
    z, rng = model.expand(x), np.random.default_rng(seed)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    won, lost = rng.choice(better, pairs), rng.choice(worse, pairs)
    w = np.zeros(z.shape[1])
    for _ in range(25):
        curve, slope = np.zeros((len(w), len(w))), np.zeros(len(w))
        for at in range(0, pairs, STEP):  # differences of all pairs at once would be hundreds of MB
            d = z[won[at : at + STEP]] - z[lost[at : at + STEP]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            curve += (d * (p * (1 - p))[:, None]).T @ d
            slope += d.T @ p
        step = np.linalg.solve(curve / pairs + ridge * np.eye(len(w)), slope / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strengths = np.sort(z @ w)
    bad = int((good == 0).sum())
    return Model(model.mean, model.scale, w, float((strengths[bad - 1] + strengths[bad]) / 2))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_buffer().to_pybytes()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "good", "h", "x"])


def _part(batches: Iterator[pa.RecordBatch], task: Callable[[Rows], object]) -> Iterator[pa.RecordBatch]:
    """One row of a task's result; none of a part without rows."""
    full = (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP))
    first = next(full, None)
    if first is not None:
        rows = (b for some in ([first], full) for b in some)
        got = task((b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), b.column(0).to_numpy()) for b in rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["got"])


def over(table: DataFrame) -> Over:
    """For fit_over(): a table (good, x); its parts are files, TASKS at most, and come in the order of the files."""
    return lambda task: [pickle.loads(r.got) for r in table.mapInArrow(frugal(partial(_part, task=task)), "got binary").collect()]


def _kept(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(text)]
        if own:
            yield batch.filter(pa.array(model.score(np.array(own)) >= 0.5))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column(0)]).reshape(batch.num_rows, -1)
        s = model.score(x) if batch.num_rows else np.empty(0)
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(s, pa.float64())], [*batch.schema.names[1:], "score"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> Model:
    """A model from the labels of all documents that are not held out; fit_rows: of so many, by hash."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    known = known.filter(~held_out(F.col("doc_id"), 3, 1))
    if fit_rows is not None:
        known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = written(known, "quality-labels")
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text")).join(small(known), "doc_id").select("doc_id", "good", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = rows.mapInArrow(frugal(_featured), f"doc_id {kind}, good int, h long, x array<double>")
    # An id on several rows is one row, that of the text of least hash.
    own = own.groupBy("doc_id", "good").agg(F.min(F.struct("h", "x")).alias("least")).select("doc_id", "good", F.col("least.x").alias("x"))
    table = written(own.repartition(TASKS, "doc_id").sortWithinPartitions("doc_id").select("good", "x"), "quality-features")
    return fit_over(over(table.coalesce(TASKS)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(text_or_empty().cast("binary").alias("text"), "doc_id").mapInArrow(frugal(partial(_scored, model=model)), f"doc_id {kind}, score double")


def drop_bad(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, fit_rows: int | None = None) -> DataFrame:
    """docs that score 0.5 or more, row by row, whatever their ids: a row's text alone decides."""
    model = learn(labelled if labelled is not None else docs, labels, fit_rows)
    return docs.mapInArrow(frugal(partial(_kept, model=model, text=docs.columns.index("text"))), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

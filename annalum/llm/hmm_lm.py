"""Language-model scoring with a hidden Markov model.

The alphabet: the most frequent training words (the head, at most HEAD), one symbol for all other words (the tail), and
the end of a text. A tail word's probability is the tail symbol's times its smoothed share of the tail, so the model is
a distribution over all words, known or not, and with one state it is the base model.

1. Words are counted per task and summed by word, in training texts and in all; the counts stay distributed. The head
   is cut at a count that leaves at most HEAD words, found on a histogram of counts; only the head reaches the driver,
   and those other words that are at least a HOT-th of all tokens (HOT of them at most).
2. Texts are encoded once into arrays of 16-bit symbols, with the counts of their tail words beside, and written to the
   shared folder. Hot tail words are looked up there, so that no word's rows meet in one task later.
3. Baum-Welch: each round reads all training texts whole, runs scaled forward and backward recursions over many texts
   at once, and emits expected counts per symbol and state, which Spark sums over the tasks. The driver gets one row per
   symbol of the alphabet. Forward variables are kept at checkpoints only and computed again on the way back, so memory
   is bounded by SEGMENT tokens, not by the longest text. Rounds end when the log-likelihood of the training tokens
   gains less than a share TOLERANCE, or after ROUNDS.
4. Scoring runs the exact scaled forward recursion over every whole text. Tail words are joined with their counts, by
   a shuffled join, and added per row.

Defined results: null and empty texts are the end token alone; null ids are not held out; without training texts all
counts are 0; an empty table gives an empty result; rows repeated in full score alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import held_out, read, text_or_empty, written

HEAD, STATES, ROUNDS, TOLERANCE, LEAST_MIXED, SEED = 60_000, 8, 8, 0.002, 0.05, 3
FLUSH, HOT, TOGETHER, SEGMENT = 400_000, 512, 4_000_000, 1 << 18


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: only A-Z, only ASCII white space


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learned, text) -> word, count in texts that are learned from, count in all."""
    seen, learned, texts = (Counter(), Counter()), [0, 0], 0

    def out() -> pa.RecordBatch:
        words = [*seen[0], *(w for w in seen[1] if w not in seen[0])]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] + seen[1][w] for w in words], pa.int64())], ["word", "c", "n"])

    for batch in batches:
        for own, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts += 1
            learned[own] += 1
            seen[own].update(tokens(t.as_buffer().to_pybytes()))
        if len(seen[0]) + len(seen[1]) > FLUSH:
            yield out()
            for part in seen:
                part.clear()
    if texts:
        for own in (0, 1):
            seen[own][b"\n"] += learned[own]  # the end token; no word holds a line feed
        yield out()


@dataclass(frozen=True)
class Vocabulary:
    head: tuple[bytes, ...]
    counts: np.ndarray  # of the head, the tail symbol and the end
    total: int
    distinct: int
    tail_distinct: int
    hot: dict[bytes, int]  # count of frequent words that are not in the head

    @property
    def tail(self) -> int:
        return len(self.head)

    @property
    def end(self) -> int:
        return len(self.head) + 1

    def base(self) -> np.ndarray:
        """The base model's probability of every symbol; of the tail, of all its words and unknown ones."""
        p = self.counts + 1.0
        p[self.tail] = self.counts[self.tail] + self.tail_distinct + 1
        return p / (self.total + self.distinct + 1)


def count_words(docs: DataFrame, training) -> DataFrame:
    """word, c over the texts of docs where training holds, n over all; the end token is a line feed."""
    texts = docs.select(F.coalesce(training, F.lit(False)).alias("learned"), text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(_counts, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    everywhere = counts.agg(F.sum("n")).first()[0] or 0
    words = counts.filter("word <> X'0A' and c > 0")
    level = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted((r for r in words.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("s")).collect()), key=lambda r: -r["l"])
    least, n = 1 << 62, 0
    for r in steps:
        if (n := n + r["n"]) > head:
            break
        least = r["least"]
    ends = counts.filter("word = X'0A'").first()
    end = ends["c"] if ends else 0
    rows = sorted(((r["c"], bytes(r["word"])) for r in words.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))  # `head` rows at most
    hot = counts.filter((F.col("word") != F.expr("X'0A'")) & (F.col("c") < least) & (F.col("n") * HOT >= everywhere)).collect()  # HOT rows at most
    everything, distinct = sum(r["s"] for r in steps), sum(r["n"] for r in steps)
    in_head = [c for c, _ in rows]
    return Vocabulary(
        tuple(w for _, w in rows), np.array([*in_head, everything - sum(in_head), end], float), everything + end, distinct + (end > 0), distinct - len(rows), {bytes(r["word"]): r["c"] for r in hot})


def _encode(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    words, hot = sent.value
    index, tail = {w: i for i, w in enumerate(words)}, len(words)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["n_tokens", "ids", "tail", "times", "hot_c", "hot_times"]
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for t in batch.column(batch.num_columns - 1):
            ws = tokens(t.as_buffer().to_pybytes())
            get = index.get
            own = [get(w, tail) for w in ws]
            rest = Counter([w for w, i in zip(ws, own, strict=True) if i == tail])
            own.append(tail + 1)
            frequent = [w for w in hot if w in rest] if hot else []
            at_once = {w: rest.pop(w) for w in frequent}
            for col, value in zip(out, (len(own), np.array(own, np.uint16).tobytes(), list(rest), list(rest.values()), [hot[w] for w in frequent], list(at_once.values())), strict=True):
                col.append(value)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*batch.schema.names[:-1], *names])


def encode(docs: DataFrame, training, vocab: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, n_tokens, ids of every row of docs, its distinct tail words and how often it has them, and
    the counts of hot tail words; training: which rows are learned from."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab.head, vocab.hot))  # HEAD and HOT words at most
    learned = F.coalesce(training, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~learned).alias("held_out"), text_or_empty().cast("binary").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    added = "n_tokens long, ids binary, tail array<binary>, times array<long>, hot_c array<long>, hot_times array<long>"
    return written(rows.mapInArrow(partial(_encode, sent=sent), f"{kinds}, {added}"), "hmm-encoded")


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # by state
    move: np.ndarray  # state to state
    emit: np.ndarray  # symbol by state

    @staticmethod
    def first(vocab: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
        """The base model in every state, shaken so that they can part."""
        shaken = vocab.base()[:, None] * np.random.default_rng(seed).uniform(0.2, 1.8, (len(vocab.counts), states))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, shaken / shaken.sum(0))

    def loglik(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of symbols, by the scaled forward recursion."""
        out = np.zeros(len(ids))
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        at = 0
        while at < len(order):
            longest = max(len(ids[order[at]]), 1)
            some = order[at : at + max(1, min(4096, 2_000_000 // longest))]
            at += len(some)
            out[some] = self._together([ids[i] for i in some])
        return out

    def _together(self, ids: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(x) for x in ids])
        grid = np.zeros((lengths.max(initial=0), len(ids)), np.uint16)
        for i, x in enumerate(ids):
            grid[: len(x), i] = x
        alive = np.searchsorted(-lengths, -np.arange(len(grid)), "left")  # sequences longer than t come first
        out, alpha, scales = np.zeros(len(ids)), np.tile(self.start, (len(ids), 1)), np.ones(len(ids))
        for t, n in enumerate(alive):
            alpha = (alpha[:n] @ self.move if t else alpha[:n]) * self.emit[grid[t, :n]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            scales[:n] *= scale
            if t % 16 == 15:  # 16 steps of at least 1e-15 fit a double
                out += np.log10(scales)
                scales[:] = 1
        return out + np.log10(scales)


class Expected:
    """Expected counts of whole sequences under a model: of symbols by state, of moves, of starts, and the log-likelihood."""

    def __init__(self, model: Model, segment: int = SEGMENT):
        self.model, self.segment = model, segment
        symbols, k = model.emit.shape
        self.emitted, self.moves, self.start, self.loglik = np.zeros((k, symbols)), np.zeros((k, k)), np.zeros(k), 0.0
        self._emit, self._move = model.emit.astype(np.float32), model.move.astype(np.float32)

    def add(self, ids: list[np.ndarray]) -> None:
        """Sequences of at least one symbol. Step t of all of them lies together, the longest sequence first."""
        ids = sorted(ids, key=len, reverse=True)
        lengths = np.array([len(x) for x in ids])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        begin = np.r_[0, np.cumsum(alive)]
        flat = np.empty(begin[-1], np.uint16)
        for i, x in enumerate(ids):
            flat[begin[: len(x)] + i] = x
        # Segments of whole steps with at most `segment` symbols, or one step.
        cuts = [0]
        while cuts[-1] < len(alive):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + self.segment, "right")) - 1))
        kept = [None]  # the forward variables before each segment
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            kept.append(self._forward(flat, begin, alive, lo, hi, kept[-1])[0][begin[hi - 1] - begin[lo] :].copy())
        beta = ahead = None
        for lo, hi, before in zip(cuts[-2::-1], cuts[:0:-1], kept[::-1], strict=True):
            beta, ahead = self._backward(flat, begin, alive, lo, hi, before, beta, ahead)

    def _forward(self, flat, begin, alive, lo, hi, before):
        own, k = slice(begin[lo], begin[hi]), len(self._move)
        alpha, scale = self._emit[flat[own]], np.empty(begin[hi] - begin[lo], np.float32)
        at = 0
        for n in alive[lo:hi].tolist():
            now = alpha[at : at + n]
            now *= self.model.start.astype(np.float32) if before is None else before[:n] @ self._move
            total = now.sum(1)
            now /= total[:, None]
            scale[at : at + n] = total
            before, at = now, at + n
        assert alpha.shape[1] == k
        return alpha, scale

    def _backward(self, flat, begin, alive, lo, hi, before, beta, ahead):
        """ahead: emission times beta over scale of the step after this segment, for sequences that reach it."""
        alpha, scale = self._forward(flat, begin, alive, lo, hi, before)
        self.loglik += float(np.log(scale, dtype=np.float64).sum())
        symbols, turned = flat[begin[lo] : begin[hi]], self._move.T.copy()
        post, gone = np.ones_like(alpha), self._emit[symbols]
        gone /= scale[:, None]
        for t in range(hi - 1, lo - 1, -1):
            at, n = begin[t] - begin[lo], alive[t]
            if ahead is not None and len(ahead):
                post[at : at + len(ahead)] = ahead @ turned
            ahead = gone[at : at + n]
            ahead *= post[at : at + n]
        if hi > lo + 1:
            # A row of step t + 1 stands alive[t] rows behind its row of step t.
            later = np.arange(alive[lo], len(alpha))
            self.moves += self.model.move * (alpha[later - np.repeat(alive[lo : hi - 1], alive[lo + 1 : hi])].astype(float).T @ gone[later])
        if beta is not None and len(beta):
            self.moves += self.model.move * (alpha[begin[hi - 1] - begin[lo] :][: len(beta)].astype(float).T @ beta)
        post *= alpha
        for j in range(len(self._move)):
            self.emitted[j] += np.bincount(symbols, post[:, j], minlength=self.emitted.shape[1])
        if lo == 0:
            self.start += post[: alive[0]].sum(0)
        return ahead, ahead


#: Symbols below 0 hold the log-likelihood (-1), starts (-2) and the moves of a state (-3 - state).
_LOGLIK, _START, _MOVES = -1, -2, -3


def _expected(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A task's expected counts, a row per symbol."""
    found, pending, tokens_in = Expected(Model(*model.value)), [], 0
    for batch in batches:
        for x in batch.column(0):
            pending.append(np.frombuffer(x.as_buffer(), np.uint16))
            tokens_in += len(pending[-1])
            if tokens_in >= TOGETHER:
                found.add(pending)
                pending, tokens_in = [], 0
    if pending:
        found.add(pending)
    k = len(found.moves)
    used = np.flatnonzero(found.emitted.any(0))
    symbol = np.r_[used, _LOGLIK, _START, _MOVES - np.arange(k)]
    rows = np.vstack([found.emitted[:, used].T, np.full(k, found.loglik / k), found.start, found.moves])
    yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int32()), *[pa.array(rows[:, j], pa.float64()) for j in range(k)]], ["symbol", *[f"s{j}" for j in range(k)]])


def renewed(emitted: np.ndarray, moves: np.ndarray, start: np.ndarray, base: np.ndarray, least_mixed: float) -> Model:
    """The next model from expected counts (emitted: symbol by state). A state mixes the base model in as if it had seen as
    many tokens of it as the alphabet has symbols, and at least `least_mixed` of it."""
    seen = emitted.sum(0)
    mixed = np.maximum(len(base) / (seen + len(base)), least_mixed)
    emit = (1 - mixed) * emitted / np.maximum(seen, 1e-9) + mixed * base[:, None]
    return Model((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))


def baum_welch(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE, least_mixed: float = LEAST_MIXED, seed: int = SEED) -> Model:
    """A model of the rows of encoded that are not held out."""
    model, base, before = Model.first(vocab, states, seed), vocab.base(), None
    training = encoded.filter("not held_out").select("ids")
    columns = [f"s{j}" for j in range(states)]
    schema = ", ".join(["symbol int", *[f"{c} double" for c in columns]])
    for _ in range(rounds if vocab.total else 0):
        sent = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))  # HEAD x states numbers
        sums = training.mapInArrow(partial(_expected, model=sent), schema).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # a row per symbol
        at, rows = sums["symbol"].to_numpy(), sums[columns].to_numpy()
        emitted, moves = np.zeros_like(model.emit), np.zeros((states, states))
        emitted[at[at >= 0]] = rows[at >= 0]
        moves[_MOVES - at[at <= _MOVES]] = rows[at <= _MOVES]
        model = renewed(emitted, moves, rows[at == _START][0], base, least_mixed)
        sent.destroy()
        now = float(rows[at == _LOGLIK].sum())
        if before is not None and now - before < tolerance * abs(before):
            break
        before = now
    return model


def _scored(batches: Iterator[pa.RecordBatch], model, base: np.ndarray, tail: int) -> Iterator[pa.RecordBatch]:
    log_base = np.log10(base)
    log_base[tail] = 0.0
    for batch in batches:
        ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(batch.num_columns - 1)]
        own = [float(log_base[x].sum()) for x in ids]
        known = [int((x != tail).sum()) for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(known, pa.int64()), pa.array(own, pa.float64()), pa.array(Model(*model.value).loglik(ids), pa.float64())], [*batch.schema.names[:-1], "head_known", "head_base", "symbols"])


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every row."""
    sent = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    rows = encoded.select("row", "doc_id", "held_out", "n_tokens", "ids")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    heads = rows.mapInArrow(partial(_scored, model=sent, base=vocab.base(), tail=vocab.tail), f"{kinds}, head_known long, head_base double, symbols double")
    words = encoded.filter("size(tail) > 0").select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    per_base, per_tail = float(vocab.total + vocab.distinct + 1), float(vocab.counts[vocab.tail] + vocab.tail_distinct + 1)
    share = lambda c, times, per: times * F.log10((c + 1) / F.lit(per))
    tails = words.join(counts.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(share(c, F.col("times"), per_base)).alias("tail_base"), F.sum(share(c, F.col("times"), per_tail)).alias("tail_share"))
    total = lambda each, zero: F.aggregate(F.zip_with("hot_c", "hot_times", each), zero if isinstance(zero, Column) else F.lit(zero), lambda a, x: a + x)
    hot = encoded.filter("size(hot_c) > 0").select("row", total(lambda c, n: F.when(c > 0, n).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long")).alias("tail_known"), total(lambda c, n: share(c, n, per_base), 0.0).alias("tail_base"), total(lambda c, n: share(c, n, per_tail), 0.0).alias("tail_share")) if vocab.hot else None
    if hot is not None:
        tails = tails.unionByName(hot).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("tail_known", "tail_base", "tail_share")])
    none = lambda col: F.coalesce(F.col(col), F.lit(0))
    end_known = 0 if vocab.counts[vocab.end] else 1
    return heads.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") - end_known + none("tail_known")).alias("n_known"), (F.col("head_base") + none("tail_base")).alias("base_score"), (F.col("symbols") + none("tail_share")).alias("score"))


def lm_scores(docs: DataFrame, training, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary]:
    """The scores of every row of docs under a model of those where `training` holds, and the vocabulary."""
    if head > 65_000:
        raise ValueError("symbols have 16 bits")
    counts = written(count_words(docs, training), "hmm-counts")
    vocab = vocabulary(counts, head)
    encoded = encode(docs, training, vocab)
    return score(encoded, counts, vocab, baum_welch(encoded, vocab, states, rounds)), vocab


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, vocab = lm_scores(docs, ~held_out(F.col("doc_id"), 7, 2))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")

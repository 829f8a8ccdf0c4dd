"""Operators against brute force, and on awkward and empty tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalum.llm import exact_dedup, hmm_lm, language_id, mixing, packing, quality_classifier, quality_rules, sharding, simhash, url_filters
from annalum.llm.common import held_out
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# ---- exact dedup

def test_directory_splits_only_overfull_buckets():
    assert set(exact_dedup.directory({}, 10)) == {1}
    deep = exact_dedup.directory({0: 30, 1: 30, 65535: 5}, 40)
    assert deep[0] == deep[1] == 16 and deep[65535] == 1 and deep[2] == 15


def test_buckets_split_and_verdicts_do_not_change(spark, docs):
    answers = []
    for capacity in (1, 20, 10**6):
        entries, index, depth = exact_dedup.build(docs, capacity)
        held = [r.k for r in index.groupBy("bucket").agg(F.count("*").alias("k")).collect()]
        distinct = entries.select("key").distinct().count()
        assert sum(held) == distinct and len(held) <= sum(1 for i, d in enumerate(depth) if i % (1 << (exact_dedup.DEEPEST - d)) == 0)
        assert max(held) <= capacity or max(depth) == exact_dedup.DEEPEST
        assert capacity > distinct or max(depth) > 1
        owned = index.select("bucket", F.expr("key").alias("key")).collect()
        assert all((r.key % (1 << 64)) >> 64 - max(depth) == r.bucket >> 1 for r in owned if max(depth) == depth[(r.key % (1 << 64)) >> 48])
        answers.append(sorted(map(tuple, exact_dedup.exact_dedup(docs, capacity).collect())))
    assert answers[0] == answers[1] == answers[2]


def test_texts_under_one_key_are_apart(spark, monkeypatch):
    """Chains: texts that collide under a key become links of their own."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda c: real(c) if isinstance(c, str) else F.lit(7).cast("long"))
    got = exact_dedup.links(docs, spark.createDataFrame([(7, 6)], "key long, n long"), [1] * (1 << exact_dedup.DEEPEST)).collect()
    assert sorted((r.link, r.keep_id, r.group_size) for r in got) == [(1, 5, 3), (2, 4, 2), (3, 3, 1)]


def test_copies(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward, capacity=1).collect()
    assert len(got) == len(AWKWARD)
    empty = [r for r in got if r.group_size == 3]
    assert {r.doc_id for r in empty} == {2, 3, None} and all(r.keep_id == 3 for r in empty) and [r.doc_id for r in empty if r.kept] == [3]
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]


# ---- sharding

def test_slot_maps_move_little():
    load = [(i * 7919) % 1000 + 1 for i in range(512)]
    old = sharding.SlotMap.balanced(load, 8)
    assert max(old.loads(load)) - min(old.loads(load)) <= max(load)
    new = old.grown(load)
    moved = [(a, b) for a, b in zip(old.shard_of, new.shard_of, strict=True) if a != b]
    assert all(b == 8 for _, b in moved) and new.version == 2 and max(new.loads(load)) <= 1.1 * sum(load) / 9
    load[3] += 20_000
    assert max(old.rebalanced(load).loads(load)) <= max(old.loads(load))


def test_shards(spark, docs, awkward, nothing):
    for df in (docs, awkward):
        got = sharding.assign(df, 8, name="test").collect()
        assert len(got) == df.count()
        for shard in range(8):
            own = sorted(r.slot for r in got if r.shard == shard)
            assert own == list(range(len(own)))
    full = sharding.assign(docs, 8).collect()
    by = Counter()
    for r in full:
        by[r.shard] += r.size
    assert max(by.values()) - min(by.values()) <= max(r.size for r in full)
    raw = texts_of(docs)
    assert all(r.size == len(raw[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(raw[r.doc_id].encode()) for r in full)
    assert sharding.assign(nothing).count() == 0
    at = sharding.SlotMap.balanced([1, 2, 3], 2)
    assert sharding.SlotMap.load(spark, at.store(spark, "round")) == at


def test_versions_of_a_map_are_edited(spark, docs):
    """The same table again makes no version; more shards, and other loads, each make the next one and move little."""
    version = lambda: sharding.SlotMap.latest(spark, "edited-64", 64)
    assert version() is None
    of = lambda df, shards: {r.doc_id: r.shard for r in sharding.assign(df, shards, 64, name="edited").collect()}
    first = of(docs, 4)
    one = version()
    assert of(docs, 4) == first and version() == one and one.version == 1
    grown = of(docs, 5)
    two = version()
    assert two.version == 2 and two.shards == 5 and all(b in (a, 4) for a, b in zip(one.shard_of, two.shard_of, strict=True) if a != b and b == 4)
    assert sum(grown[i] != first[i] for i in first) < len(first) / 2 and set(grown.values()) == set(range(5))
    more = docs.unionByName(docs.filter("doc_id % 7 = 0").withColumn("text", F.repeat("text", 30)))
    of(more, 5)
    three = version()
    load = sharding.slot_loads(sharding.slotted(more, 64), 64)[0]
    assert three.version == 3 and max(three.loads(load)) <= max(two.loads(load))
    folder = sharding._folder(spark, "edited-64")
    assert [sharding.SlotMap.load(spark, f"{folder}/v{i:06d}") for i in (1, 2, 3)] == [one, two, three]
    with pytest.raises(ValueError):
        two.edited(load, 3)


# ---- mixing

def test_targets_are_a_water_level(spark):
    sizes = {"a": 100, "b": 5, "c": 400, "d": 60}
    df = spark.createDataFrame([(False, s, n) for s, n in sizes.items()] + [(True, "", 7)], "no_source boolean, src string, source_size long")
    got = {(r.no_source, r.src): r.target for r in mixing.targets(df).collect()}
    order = [(False, s) for s in sorted(sizes)] + [(True, "")]
    size = {k: sizes.get(k[1], 7) for k in order}
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    target, full, total = {}, set(), sum(size.values())
    while True:
        left, w = total - sum(3 * size[k] for k in full), sum(weight[k] for k in order if k not in full)
        target = {k: 3.0 * size[k] if k in full else left * weight[k] / w for k in order}
        over = {k for k in order if k not in full and target[k] > 3 * size[k]}
        if not over:
            break
        full |= over
    assert all(abs(target[k] - got[k]) < 1e-9 for k in order)


def test_mix(docs, awkward, nothing):
    for options in ({}, {"bucket_rows": 3}):
        got = mixing.mix(docs, **options).collect()
        assert len(got) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
        for source in {r.source for r in got}:
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))
    got = mixing.mix(awkward).collect()
    assert len(got) == len(AWKWARD) and sum(r.taken for r in got if r.size == 0) == 0
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# ---- quality rules

def test_rules(awkward, nothing):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(awkward).collect()}
    long = got[5, 6000]
    assert long.n_repeat_words == 6000 and long.base_failed and not long.kept
    assert got[10, 8].n_dup_lines == 1 and got[6, 0].word_chars == 0
    assert quality_rules.judge(nothing).count() == 0


def test_lines_of_white_space(spark):
    """A form feed is white space, the letter f is not."""
    df = spark.createDataFrame([(1, "f\nf\nf\nx"), (2, "\f\n\f\n\f\nx"), (3, "a\fb\na\fb")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source")
    got = {r.doc_id: (r.n_words, r.n_dup_lines) for r in quality_rules.judge(df).collect()}
    assert got == {1: (4, 2), 2: (1, 0), 3: (4, 1)}


def test_sketches_merge(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", *[f"id * {i + 1} as {r}" for i, r in enumerate(quality_rules.RULES)])
    whole = quality_rules.quantiles(quality_rules.sketches(df.withColumn("one", F.lit(1)), ["one"]), ["one"]).collect()
    parts = quality_rules.merged(quality_rules.sketches(df.withColumn("one", F.lit(1)), ["one", "g"]), ["one"])
    assert sorted(map(tuple, quality_rules.quantiles(parts, ["one"]).collect())) == sorted(map(tuple, whole))
    for level, q in ((0.25, "q1"), (0.75, "q2"), (0.95, "q3")):
        assert all(abs(r[q] / (5000 * level * (1 + list(quality_rules.RULES).index(r.rule))) - 1) < 0.06 for r in whole)


def test_limits_follow_their_group(spark):
    """Groups of different shares get different limits, small groups about those of their language, and none where nothing was seen."""
    rows = [("=a", f"={s}", 10 * s * (i % 10), 100 * s if i % 4 else 0, 0, 10 + s * (i % 20), 400 + s * (i % 30)) for s in (1, 2, 3) for i in range(400)] + [("=a", "=few", 5, 5, 0, 12, 410)]
    df = spark.createDataFrame(rows, f"lang_key string, source_key string, {', '.join(f'{r} int' for r in quality_rules.RULES)}")
    keys = ["lang_key", "source_key"]
    sketch = quality_rules.sketches(df, keys)
    got = {r.source_key: r for r in quality_rules.thresholds(sketch).collect()}
    for limit in ("symbols_high", "dup_lines_high", "capitals_high", "word_length_low", "word_length_high"):
        assert len({got[f"={s}"][limit] for s in (1, 2, 3)}) == 3, limit
    assert all(r.repeats_high is None for r in got.values())
    whole = quality_rules.thresholds(quality_rules.sketches(df.withColumn("source_key", F.lit("=x")), keys)).first()
    for limit in ("capitals_high", "symbols_high"):  # its own row weighs one in 21
        assert abs(got["=few"][limit] / whole[limit] - 1) < 0.1


def test_limits_do_not_jump_with_size(spark):
    """A source that is unlike its language moves from its language's limit to its own, step by step, as it grows."""
    names = list(quality_rules.RULES)
    lang = [("=a", "=big", *(10 * (i % 10) for _ in names)) for i in range(1000)]
    keys, limits = ["lang_key", "source_key"], []
    for n in (1, 20, 60, 99, 100, 101, 140, 400):
        rows = lang + [("=a", "=own", *(1000 + 10 * (i % 10) for _ in names)) for i in range(n)]
        df = spark.createDataFrame(rows, f"lang_key string, source_key string, {', '.join(f'{r} int' for r in names)}")
        limits.append({r.source_key: r for r in quality_rules.thresholds(quality_rules.sketches(df, keys)).collect()}["=own"])
    widths = [r.word_length_high for r in limits]
    assert widths[0] < 400 and widths[-1] > 1000
    assert abs(widths[3] - widths[5]) / widths[4] < 0.1 and abs(limits[3].capitals_high - limits[5].capitals_high) / limits[4].capitals_high < 0.1


# ---- packing

def test_bins_are_best_fit():
    closed = []
    bins = packing.Bins(10, 2, lambda items: closed.append([n for _, n in items]))
    for n in (6, 5, 4, 3, 9, 8):
        bins.add([(None, n)], n)
    assert closed[0] == [6, 4] and closed[1] == [9]  # the fullest goes when a third is open
    bins.finish()
    assert sorted(map(sum, closed)) == [8, 8, 9, 10]


def test_bins_close_under_pressure():
    """Plain best-fit in the order of arrival; whenever a bin too many is open, the fullest goes."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 3000).tolist()
    closed, forced, bins = [], 0, []
    packer = packing.Bins(100, 8, lambda items: closed.append([n for _, n in items]))
    want = []
    for n in lengths:
        packer.add([(None, n)], n)
        fits = [b for b in bins if sum(b) + n <= 100]
        into = max(fits, key=sum) if fits else []
        if not fits:
            bins.append(into)
        into.append(n)
        full = [b for b in bins if sum(b) == 100]
        if not full and len(bins) > 8:
            forced += 1
            full = [max(bins, key=sum)]
        for b in full:
            bins = [x for x in bins if x is not b]
            want.append(sum(b))
    assert forced > 500 and [sum(b) for b in closed] == want and packer.n == len(bins) <= 8


def test_special_tokens():
    from tokenizers import Tokenizer

    file = packing.vocabulary_files()[0]
    assert sorted(packing.special_tokens(file)) == sorted(t.content for t in Tokenizer.from_file(file).get_added_tokens_decoder().values())


def test_cut():
    assert list(packing.cut(5, 4)) == [(0, 1), (1, 4)] and list(packing.cut(8, 4)) == [(0, 4), (4, 4)] and list(packing.cut(3, 4)) == [(0, 3)]


def test_pieces_are_the_tokenizers_ids(docs, awkward, nothing):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_files()[0])
    for df in (docs, awkward):
        got = packing.packed(df, open_bins=16).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            for piece, (start, length) in enumerate(packing.cut(len(ids), 1024)):
                want[r.doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
        assert len(by) <= 1.2 * sum(r.length for r in got) / 1024 + 2
    assert packing.packed(nothing).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "x \n y", "\n\n", "a\u00a0 b", "a \u3000b", "it's 12 o'clock", "tab\t end", "x\x1c y \x85 z", "\u2028 q", "é  \n  ß", "a <|endoftext|> b"])
def test_encoder(text):
    from tokenizers import Tokenizer

    files = packing.vocabulary_files()
    assert np.frombuffer(packing.encoder(files)(text), np.uint32).tolist() == Tokenizer.from_file(files[0]).encode(text, add_special_tokens=False).ids


# ---- SimHash

def slow_components(fps: dict, radius=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most", [4096, 3])
def test_links_of_clusters(spark, most):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(12):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = dict(enumerate(sorted(fps)))
    from annalum.llm.common import written

    table = written(spark.createDataFrame([(x,) for x in fps.values()], "fp long"), "test-fps")
    pairs = simhash.links(table, most=most).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in pairs)
    roots = {r.node: r.root for r in simhash.components(simhash.links(table, most=most)).collect()}
    want = slow_components(fps)
    assert all(roots.get(x, x) == fps[want[i]] for i, x in fps.items())


def test_near_duplicates(docs, awkward, nothing):
    for df in (docs.withColumn("row", F.lit(1)), awkward):
        got = simhash.near_duplicates(df).collect()
        assert len(got) == df.count()
        raw = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in df.select("doc_id", "text").collect()]
        assert Counter((r.doc_id, r.fp) for r in got) == Counter(raw)
        want = slow_components(dict(enumerate(fp for _, fp in raw)))
        members = defaultdict(set)
        for i, c in want.items():
            members[c].add(raw[i][0])
        expect = {raw[i][1]: min((x for x in members[c] if x is not None), default=None) for i, c in want.items()}
        assert all(r.component_id == expect[r.fp] for r in got)
    assert simhash.near_duplicates(nothing).count() == 0


def test_fingerprint_by_the_book():
    import xxhash

    text = "One two\tTHREE four five É one"
    words = text.translate({c: c + 32 for c in range(65, 91)}).split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b"A b") & (2**64 - 1) == xxhash.xxh64_intdigest("a b", 42)


def test_ball_covers_the_radius():
    rng = np.random.default_rng(2)
    ball = simhash.projected_ball()
    assert len(ball) == 131
    for _ in range(300):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        own = lambda x: {((x & (m & (2**64 - 1))) ^ (f & (2**64 - 1))) for m, f in ball}
        assert own(a) & own(b)


# ---- language model

def slow_loglik(model, ids):
    """By the plain forward recursion in logarithms."""
    alpha = np.log(model.start) + np.log(model.emit[ids[0]])
    for x in ids[1:]:
        alpha = np.array([np.logaddexp.reduce(alpha + np.log(model.move[:, j])) for j in range(len(alpha))]) + np.log(model.emit[x])
    return np.logaddexp.reduce(alpha) / math.log(10)


def test_scores_of_a_language_model(spark, docs, awkward):
    for df, head in ((docs, 500), (awkward, 4)):
        training = ~held_out(F.col("doc_id"), 7, 2)
        counts = hmm_lm.written(hmm_lm.count_words(df, training), "test-counts")
        vocab = hmm_lm.vocabulary(counts, head)
        encoded = hmm_lm.encode(df, training, vocab)
        model = hmm_lm.baum_welch(encoded, vocab, 3, 2)
        rows = df.select("doc_id", "text").collect()
        learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
        words = lambda t: [*hmm_lm.tokens((t or "").encode()), b"\n"]
        c = Counter(w for r in rows if learns(r.doc_id) for w in words(r.text))
        total, distinct = sum(c.values()), len(c)
        assert (vocab.total, vocab.distinct) == (total, distinct) and len(vocab.head) <= head
        assert abs(vocab.base().sum() - 1) < 1e-9 and np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
        index = {w: i for i, w in enumerate(vocab.head)} | {b"\n": vocab.end}
        share = vocab.counts[vocab.tail] + vocab.tail_distinct + 1
        want = Counter()
        for r in rows:
            ws = words(r.text)
            base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws)
            full = slow_loglik(model, [index.get(w, vocab.tail) for w in ws]) + sum(math.log10((c[w] + 1) / share) for w in ws if w not in index)
            want[r.doc_id, not learns(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), round(base, 4), round(full, 4)] += 1
        got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in hmm_lm.score(encoded, counts, vocab, model).collect())
        near = sorted(got.elements(), key=repr), sorted(want.elements(), key=repr)
        assert len(near[0]) == len(near[1])
        for a, b in zip(*near, strict=True):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3 and abs(a[5] - b[5]) < 1e-3


def slow_expected(model, texts):
    """Plain Baum-Welch counts in double precision, one text at a time."""
    symbols, k = model.emit.shape
    emitted, moves, start, loglik = np.zeros((symbols, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for ids in texts:
        alpha, scale = np.zeros((len(ids), k)), np.zeros(len(ids))
        for t, x in enumerate(ids):
            alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * model.emit[x]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones((len(ids), k))
        for t in range(len(ids) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[ids[t + 1]] * beta[t + 1]) / scale[t + 1]
            moves += model.move * np.outer(alpha[t], model.emit[ids[t + 1]] * beta[t + 1] / scale[t + 1])
        for t, x in enumerate(ids):
            emitted[x] += alpha[t] * beta[t]
        start += alpha[0] * beta[0]
        loglik += np.log(scale).sum()
    return emitted, moves, start, loglik


@pytest.mark.parametrize("segment", [1, 7, 300, 1 << 18])
def test_expected_counts_of_whole_texts(segment):
    """Whatever the checkpoints, counts of long and short texts are those of the plain recursions."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 1, 2, 5, 700, 3, 64, 64, 300)]
    model = hmm_lm.Model(np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    found = hmm_lm.Expected(model, segment)
    found.add(texts[:5])
    found.add(texts[5:])
    emitted, moves, start, loglik = slow_expected(model, texts)
    assert np.allclose(found.emitted.T, emitted, rtol=1e-3, atol=1e-3) and np.allclose(found.moves, moves, rtol=1e-3, atol=1e-3)
    assert np.allclose(found.start, start, atol=1e-3) and abs(found.loglik - loglik) < 1e-3 * abs(loglik)


def test_training_is_plain_baum_welch(spark):
    """Two rounds over a table with a text longer than any block, against the plain recursions; and rounds that gain nothing end."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(int(x), 30)}" for x in rng.exponential(6, n))) for i, n in enumerate([3000, 0, 10, 40, 1, 400] * 3)], "doc_id long, text string").repartition(3)
    training = F.col("doc_id") % 5 != 2
    counts = hmm_lm.written(hmm_lm.count_words(docs, training), "test-bw-counts")
    vocab = hmm_lm.vocabulary(counts, 12)
    encoded = hmm_lm.encode(docs, training, vocab)
    got = hmm_lm.baum_welch(encoded, vocab, 3, 2)
    texts = [np.frombuffer(r.ids, np.uint16) for r in encoded.filter("not held_out").collect()]
    want, base = hmm_lm.Model.first(vocab, 3), vocab.base()
    for _ in range(2):
        emitted, moves, start, _ = slow_expected(want, texts)
        want = hmm_lm.renewed(emitted, moves, start, base, hmm_lm.LEAST_MIXED)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-6) for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)))
    one = hmm_lm.baum_welch(encoded, vocab, 3, 2, tolerance=-1.0)
    assert np.allclose(one.emit, got.emit)
    stopped, two = hmm_lm.baum_welch(encoded, vocab, 3, 50, tolerance=10.0), hmm_lm.baum_welch(encoded, vocab, 3, 2)
    assert np.allclose(stopped.emit, two.emit)


def test_words_that_only_held_out_texts_have(spark):
    """A frequent word without training counts is scored where its text is, not by a join on it."""
    docs = spark.createDataFrame([(i, "known " * 5 if i % 2 else "unknown " * 5 + f"rare{i}") for i in range(40)], "doc_id long, text string")
    training = F.col("doc_id") % 2 == 1
    counts = hmm_lm.written(hmm_lm.count_words(docs, training), "test-hot")
    vocab = hmm_lm.vocabulary(counts, 10)
    assert vocab.hot[b"unknown"] == 0 and b"known" not in vocab.hot and (vocab.total, vocab.distinct) == (120, 2)
    encoded = hmm_lm.encode(docs, training, vocab)
    rows = hmm_lm.score(encoded, counts, vocab, hmm_lm.baum_welch(encoded, vocab, 2, 2)).collect()
    for r in rows:
        known = 6 if r.doc_id % 2 else 1
        base = 5 * math.log10(101 / 123) + math.log10(21 / 123) if r.doc_id % 2 else 6 * math.log10(1 / 123) + math.log10(21 / 123)
        assert r.n_known == known and abs(r.base_score - base) < 1e-6


def test_model_beats_the_base(docs, nothing):
    got = hmm_lm.lm_scores(docs, ~held_out(F.col("doc_id"), 7, 2))[0].filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert hmm_lm.lm_scores(nothing, F.lit(True))[0].count() == 0


# ---- classifiers

def test_quality_of_held_out_texts(spark, data, docs, awkward, nothing):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality_classifier.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == q for s, q in held]) >= 0.9
    scored = quality_classifier.score(awkward, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored)
    none = quality_classifier.learn(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(awkward, none).collect()} == {0.5}
    assert quality_classifier.score(nothing, model).count() == 0
    assert quality_classifier.drop_bad(docs, labels).columns == docs.columns


def test_bradley_terry_orders_what_it_is_told():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_classifier.features(b""))))
    good = (x[:, 3] > 0.5).astype(int)
    model = quality_classifier.fit(x, good, pairs=5000)
    assert ((model.score(x) >= 0.5) == good).mean() > 0.95
    assert (model.score(x) < 0.5).sum() == (good == 0).sum()  # the cut is a quantile


def test_languages_of_held_out_texts(docs, awkward, nothing):
    model = language_id.learn(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"), 4, 2)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95
    odd = language_id.identify(awkward, model).collect()
    assert Counter(r.lang_pred for r in odd)["und"] == 5 and all(0 <= r.score <= 1 for r in odd)
    assert language_id.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.learn(nothing)).collect()} == {"und"}


def test_languages_by_hand(spark, docs):
    """Cosines with the centroids, and the cluster means, in plain Python."""
    fitted = language_id.learn(docs, per_language=20, centroids=3)
    model = next(fitted.models())
    rows = docs.filter("text is not null").limit(40).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in language_id.identify(docs, fitted).collect()}
    for r in rows:
        counts = language_id.ngrams(r.text)
        v = [(1 + math.log(c)) * w if c else 0.0 for c, w in zip(counts.tolist(), model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        cosines = [sum(a * b for a, b in zip(v, c, strict=True)) / norm for c in model.centroids.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        if got[r.doc_id].lang_pred != "und":
            assert abs(got[r.doc_id].score - cosines[best]) < 1e-4
            assert abs(cosines[best] - max(c for c, o in zip(cosines, model.owner, strict=True) if model.languages[o] == got[r.doc_id].lang_pred)) < 1e-4
    points = np.array([[1.0, 0.1, 0], [1, 0, 0.1], [0.1, 1, 0], [0, 1, 0.1], [0, 0.1, 1]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = language_id.cluster(points, 3)
    means = [points[:2].mean(0), points[2:4].mean(0), points[4]]
    assert sorted(np.round(c, 6).tolist() for c in centres) == sorted(np.round(m / np.linalg.norm(m), 6).tolist() for m in means)


def plain_ngrams(text, dimensions=4096):
    """The hashed counts with Python's integers."""
    out, b, m = [0] * dimensions, text.lower().encode("utf-8", "replace"), 2**32
    for factors in ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2654435769)):
        for i in range(len(b) - len(factors) + 1):
            h = sum((b[i + j] + 1) * f for j, f in enumerate(factors)) % m
            h = (h ^ h >> 15) * 2246822519 % m
            out[(h >> 8) % dimensions] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab", "Grüße, 中文!", "x" * 300, "The end\n\t."])
def test_ngrams_in_plain_python(text):
    assert language_id.ngrams(text).tolist() == plain_ngrams(text)


def test_many_languages(spark):
    """501 languages, in one range and in many: the same answers, and texts of few languages are told apart."""
    letters = "bcdfghjklmnpqrstvwxz"
    rows = [(i, f"{letters[i % 20]}a{letters[i // 20 % 20]}o{letters[i // 400 % 20]}i " * (4 + j % 2), f"l{i % 501:03d}") for j in range(3) for i in range(501)]
    docs = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    whole, cut = language_id.learn(docs, dimensions=256, centroids=2), language_id.learn(docs, dimensions=256, centroids=2, most_centroids=150)
    assert len(whole.ranges) == 1 and len(cut.ranges) == 7
    got = [sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in language_id.identify(docs, f).collect()) for f in (whole, cut)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert sum(lang == rows[k][2] for k, lang, _ in got[0]) > 0.9 * len(rows)


def test_features_in_plain_python():
    """Every feature of a text by a plain count."""
    text = "The CAT sat. The CAT sat. 12 a b!\n\nline é\nline é\n"
    raw = text.encode()
    got = quality_classifier.features(raw)
    share = lambda ok: sum(map(ok, raw)) / len(raw)
    kinds = [share(lambda c, k=k: c in k) for k in quality_classifier.KINDS]
    words = raw.split()
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / len(lengths)
    want = [*kinds, math.log(1 + len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)), max(lengths), len(set(words)) / len(words), max(Counter(words).values()) / len(words),
            1 - len(set(grams)) / len(grams), 1 - len(set(lines)) / len(lines), math.log(1 + len(words) / len(lines)), sum(chr(w[-1]).isalpha() or w[-1] >= 128 for w in words) / len(words),
            sum(w.decode().isupper() for w in words) / len(words), sum(len(w) == 1 for w in words) / len(words)]
    assert np.allclose(got, want)


def test_quality_by_hand():
    """Weights at the least of the penalised logistic loss of the pairs' differences, by plain gradient descent."""
    rng = np.random.default_rng(5)
    x, width = rng.normal(size=(60, len(quality_classifier.features(b"")))), 2 * len(quality_classifier.features(b""))
    good = (x[:, 0] + x[:, 1] + rng.normal(size=60) > 0).astype(int)
    model = quality_classifier.fit(x, good, pairs=300, ridge=0.5, seed=2)
    z, draw = model.expand(x), np.random.default_rng(2)
    d = z[draw.choice(np.flatnonzero(good == 1), 300)] - z[draw.choice(np.flatnonzero(good == 0), 300)]
    w = np.zeros(width)
    for _ in range(4000):
        w += 0.02 * (d.T @ (1 / (1 + np.exp(d @ w))) / 300 - 0.5 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    strengths = sorted((z @ w).tolist())
    bad = int((good == 0).sum())
    assert abs(model.cut - (strengths[bad - 1] + strengths[bad]) / 2) < 1e-3


# ---- URL filters

def test_ranges_do_not_change_verdicts(spark):
    import random

    rnd = random.Random(3)
    labels = ["a", "b", "com", "net"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    pages = spark.createDataFrame([(i, f"x://{h}/{rnd.choice('ab')}/{rnd.choice('ab')}") for i, h in enumerate(hosts)] + [(1000 + i, "x://a.com/a/a") for i in range(300)], "page_id long, url string")
    rules = [(".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 3))), rnd.choice(["/", "/a/", "/a/b"]), rnd.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = {}
    for r in pages.collect():
        host, path = r.url[4:].split("/", 1)[0], "/" + r.url[4:].split("/", 1)[1]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = min(fits, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0]), x)) if fits else None
        want[r.page_id] = (best[0] + best[1], best[2]) if best else (None, "allow")
    for tasks in (1, 7, 60):
        got = url_filters.filter_urls(pages, table, tasks=tasks).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in got} == want and len(got) == len(want)
    assert url_filters.filter_urls(pages.limit(0), table).count() == 0


def test_release_deletes_what_was_written(spark):
    import os

    from annalum.llm import common

    path = common.written(spark.range(3), "test-release").inputFiles()[0].removeprefix("file://")
    before, common._PATHS[:] = common._PATHS[:-1], common._PATHS[-1:]
    common.release(spark)
    common._PATHS[:] = before
    assert not os.path.exists(path)

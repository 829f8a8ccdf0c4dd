"""Near-copies against brute-force Jaccard over five-word shingles."""

import random

import pytest

from annalum.llm import simhash, similar


def slow_groups(texts: dict) -> dict:
    """id -> smallest id that links of similarity >= 0.8 connect."""
    def cut(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def edited(words: list[str], edits: int, rng: random.Random) -> list[str]:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("sample", "crowd", "cell"), [(1, 4096, 512), (10_000, 4096, 512), (1, 6, 3)])
def test_near_copies(spark, monkeypatch, sample, crowd, cell):
    """With a sample that shows nothing, shingles that crowd heads are demoted, and groups are cut into small cells."""
    for name, value in (("SAMPLE", sample), ("CROWD", crowd), ("CELL", cell)):
        monkeypatch.setattr(similar, name, value)
    monkeypatch.setattr(similar.cells, "__defaults__", (cell,))
    rng, texts = random.Random(7), {}
    shared = [f"common{i}" for i in range(30)]
    for g in range(12):  # near and not so near copies, with one passage in all
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 40, 200, 300)))] + shared
        for k in range(8):
            texts[len(texts)] = " ".join(edited(words, k * len(words) // 80, rng))
    words = [f"x{i}" for i in range(120)]
    for _ in range(40):  # a group that is mostly not alike
        texts[len(texts)] = " ".join(edited(words, rng.randrange(1, 8), rng))
    texts |= {1000: "", 1001: None, 1002: " \n", 1003: "One two", 1004: "one  TWO", 1005: "two one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    expected = slow_groups(texts)
    assert 40 < len(set(expected.values())) < len(texts) - 40
    assert {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()} == expected
    assert sorted(r.doc_id for r in similar.drop_near_copies(docs).collect()) == sorted(set(expected.values()))


def test_odd_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = similar.drop_near_copies(awkward)
    assert got.columns == awkward.columns
    # 4 is 1 again, 8 shares eight of ten shingles with it; 3, 6 and a row without id are as empty as 2
    stay = sorted((i is None, i or 0) for i, t in rows if i not in (3, 4, 6, 8) and (i is not None or t))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == stay
    assert similar.drop_near_copies(nothing).collect() == []


def test_rows_without_ids_and_string_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b  c d e f"), (None, "q"), ("x", "one two"), ("w", "one two"), (None, "one two"), ("x", "three")]
    got = similar.drop_near_copies(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.text.lower().replace("  ", " ")) for r in got) == [("", "a b c d e f"), ("", "q"), ("w", "one two"), ("x", "three")]


def test_parity_folds_and_bounds():
    rng = random.Random(3)
    for n in (1, 300, 520, 4000):
        x = similar.shingles(" ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4)).encode())
        y = similar.np.unique(similar.np.r_[x[: n * 9 // 10], x[: n // 20] + similar.np.uint64(1)])
        a, b = similar.parity(x), similar.parity(y)
        if len(a) > len(b):
            a = a[: len(b)] ^ a[len(b) :]
        assert similar.np.bitwise_count((a ^ b).view(similar.np.uint64)).sum() <= len(similar.np.setxor1d(x, y))


def test_long_texts_of_several_widths(spark, monkeypatch):
    """Long near copies that no star connects; parity of different widths."""
    rng, texts = random.Random(9), {}
    shared = [f"p{i}" for i in range(400)]
    for g in range(6):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice((420, 500, 560, 1000, 1100)))] + shared
        for k in range(5):
            texts[len(texts)] = " ".join(edited(words, k * 4, rng) + [f"t{rng.randrange(10**6)}" for _ in range(20 * k)])
    assert len({len(similar.parity(similar.shingles(t.encode()))) for t in texts.values()}) > 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "simhash_pairs", lambda nodes: nodes.select("node", "node").limit(0).toDF("a", "b"))
    assert {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()} == slow_groups(texts)


def test_crowded_heads_are_emptied(spark, monkeypatch):
    """One passage in texts that are otherwise unlike, and a sample that misses it: no head holds it in the end."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(12))
    fresh = lambda: " ".join(f"w{rng.randrange(10**7)}" for _ in range(40))
    docs = spark.createDataFrame([(i, f"{fresh()} {passage} {fresh()}") for i in range(120)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "CROWD", 20)
    texts = docs.select("doc_id", similar.text_hash().alias("text_hash"), docs["text"].cast("binary").alias("text"))
    nodes = similar.written(similar._headed(texts, {}).drop("doc_id"), "test-nodes")
    met = similar._met(nodes)
    most = lambda df: max([r["count"] for r in df.filter("token is not null").groupBy("token").count().collect()], default=0)
    assert most(met) > 100
    after, met = similar._uncrowded(nodes, met, texts, {}, 1)
    assert most(met) <= 20 and after.count() == 120
    assert similar.near_copies(docs).filter("doc_id <> component_id").count() == 0


def test_stars_over_batches():
    """Groups that span batches give the links and members that one batch gives."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((t, n, 10) for t in range(40) for n in rng.sample(range(1000), rng.choice((1, 2, 3, 9))))

    def run(cuts):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a:b], strict=True)], ["token", "node", "n"]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if b > a]
        return {(t, a, b) for out in similar._stars(iter(batches)) for t, a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}

    whole = run([])
    assert len(whole) > 100
    for step in (1, 2, 3, 7):
        assert run(range(step, len(rows), step)) == whole


def test_close_pairs_by_brute_force():
    import numpy as np

    rng = random.Random(5)
    base = [rng.randrange(2**62) for _ in range(300)]
    sets = [np.unique(np.array(rng.sample(base, rng.randrange(200, 300)), np.uint64)) for _ in range(40)] + [np.unique(np.array([rng.randrange(2**62) for _ in range(700)], np.uint64)) for _ in range(4)]
    sets += [np.unique(np.r_[sets[-1][:650], sets[0][:30]]), np.unique(np.r_[base[:256]].astype(np.uint64)), np.unique(np.array([*base, *(x + 1 for x in base[:250])], np.uint64))]
    bits = np.empty(len(sets), object)
    bits[:] = [similar.parity(s) for s in sets]
    n, root = np.array([len(s) for s in sets]), np.array([0] * 30 + [rng.randrange(4) for _ in range(len(sets) - 30)])
    for side in (np.full(len(sets), -1), np.array([i % 2 for i in range(len(sets))])):
        got = {(min(i, j), max(i, j)) for i, js in similar.close_pairs(root, n, bits, side) for j in js.tolist()}
        want = set()
        for i in range(len(sets)):
            for j in range(i):
                x, y = (bits[i], bits[j]) if len(bits[i]) <= len(bits[j]) else (bits[j], bits[i])
                if len(y) > 2 * len(x) or root[i] == root[j] or (side[i] == side[j] and side[i] >= 0) or 5 * min(n[i], n[j]) < 4 * max(n[i], n[j]):
                    continue
                y = y[: len(x)] ^ y[len(x) :] if len(y) > len(x) else y
                if 9 * np.bitwise_count((x ^ y).view(np.uint64)).sum() <= n[i] + n[j]:
                    want.add((j, i))
        assert got == want and want


def test_settled_links_take_no_round(spark, monkeypatch):
    """Links that tasks have folded into stars are the result; only others are joined, to the same components."""
    rng, joins, join_hot = random.Random(4), [], simhash.join_hot
    monkeypatch.setattr(simhash, "join_hot", lambda *a: joins.append(1) or join_hot(*a))
    roots = lambda pairs: {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    star = [(0, i) for i in range(1, 200)] + [(1000 + i, 1000) for i in range(1, 50)]
    assert roots(star) == {max(p): min(p) for p in star} and roots([]) == {} and not joins
    ids = rng.sample(range(-(10**6), 10**6), 600)
    pairs = [(ids[i], ids[i - 1]) for i in range(1, 300)] + [tuple(rng.sample(ids[300:], 2)) for _ in range(150)]
    want = slow_links(ids, pairs)
    assert roots(pairs) == {i: r for i, r in want.items() if i != r} and joins


def slow_links(ids: list, pairs: list) -> dict:
    """id -> smallest id that pairs connect."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return root


def test_plans_of_near_copies_are_short(spark, monkeypatch):
    """What is written in one query is planned again after each of its stages, on the driver: no plan of dozens of joins."""
    rng, plans, written = random.Random(11), {}, similar.written

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return written(df, tag)

    for module in (similar, simhash):
        monkeypatch.setattr(module, "written", noted)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(edited(words, rng.randrange(9), rng))) for i in range(40)], "doc_id long, text string").repartition(3)
    similar.near_copies(docs).collect()
    assert {"similar-left", "similar-apart"} <= set(plans) and max(plans.values()) <= 6, plans

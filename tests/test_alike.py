"""String similarity against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalum.functions import strings
from annalum.operators import resolve, similar_strings


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abcé ", max_size=80))
def test_common_length(a, b):
    assert strings.common_length(a, b) == slow_common(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_matching_blocks_are_never_above(a, b):
    assert SequenceMatcher(None, a, b).ratio() <= strings.indel_ratio(a, b) + 1e-12


def test_token_sets():
    assert strings.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert strings.token_set("a b", "b a c") == 1.0
    assert strings.token_set("", "a") == strings.token_set(" ", "") == 0.0
    assert strings.token_set("abc", "abd") == pytest.approx(2 / 3)
    # shared 'x', own 'ab' and 'cd': 'x' against 'x ab' is 2/5, 'x ab' against 'x cd' is 4/8
    assert strings.token_set("x ab", "cd x") == pytest.approx(0.5)
    assert strings.indel_ratio("", "") == 1.0 and strings.indel_ratio("", "a") == 0.0


def test_columns(spark):
    rows = [("King Arthur ", "king arthur"), ("Napoleon Bonaparte", "Bonaparte"), ("abc", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(strings.combined(df["a"], df["b"])).collect()]
    assert got[0] == pytest.approx(1.0) and got[2] == got[3] == 0.0
    jaro = [r[0] for r in df.limit(2).select(resolve.jaro_winkler("a", "b")).collect()]
    assert 0 < jaro[1] < 1
    assert got[1] == pytest.approx(0.3 * jaro_low(spark) + 0.4 * 1.0 + 0.3 * 2 * 9 / 27)


def jaro_low(spark):
    df = spark.createDataFrame([("napoleon bonaparte", "bonaparte")], "a string, b string")
    return df.select(resolve.jaro_winkler("a", "b")).first()[0]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeio") for _ in range(rng.randrange(1, 6))) for _ in range(n))


def changed(s, k, rng):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s) + 1)
        s[at : at + rng.randrange(2)] = rng.choice(["", "x", rng.choice("abc")])
    return "".join(s)


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 1.0])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(100 * least))
    every = ["", "a", "b", "ab", "ba", "aa", "aaaa", "aaaaaaaaaaaaaaaaaaa", "\U0001f600a", None]
    for _ in range(60):
        s = words(rng, rng.randrange(1, 6))
        every += [s, *(changed(s, k, rng) for k in (1, 2, 4))]
    df = spark.createDataFrame([(s,) for s in every], "s string")
    got = {(r.a_s, r.b_s): r.ratio for r in similar_strings.similar(df, df, least).collect()}
    texts = sorted({s for s in every if s is not None})
    want = {(a, b): r for a in texts for b in texts if (r := strings.indel_ratio(a, b)) >= least}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    met = similar_strings.candidates(df.filter("s is not null").distinct(), df.filter("s is not null").distinct(), least).count()
    assert least < 0.9 or met < len(texts) ** 2 / 4  # far from all pairs


def test_ratio_of_blocks_serves_too(spark):
    rng = random.Random(8)
    every = sorted({changed(words(random.Random(i % 9), 4), i % 4, rng) for i in range(90)})
    df = spark.createDataFrame([(s,) for s in every], "s string")
    got = {(r.a_s, r.b_s) for r in similar_strings.similar(df, df, 0.85, resolve.sequence_ratio).collect()}
    assert got == {(a, b) for a in every for b in every if SequenceMatcher(None, a, b).ratio() >= 0.85}
    with pytest.raises(ValueError):
        similar_strings.candidates(df, df, 0.5)


def test_reconcile_by_place(spark):
    rng = random.Random(5)

    def events(n, k):
        return [(i, rng.choice(["battle of ", "siege of ", "fall of "]) + rng.choice(["troy", "tyre", "rome", "romes"]), rng.choice([None, 0, 10, 20]), rng.choice([None, 0.0, 10.0, 10.05, 10.1, -179.97, 60.2]), rng.choice([0.0, 5.0, 5.05, 5.17, None])) for i in range(k, n + k)]

    known, found = events(120, 0), events(150, 1000)
    schema = "id long, title string, year int, latitude double, longitude double"
    want, exact = set(), set()
    for a in known:
        for b in found:
            if a[1:3] == b[1:3]:
                want.add((a[0], b[0], "EXACT", 100.0))
                exact.add(b[0])
    for a in known:
        for b in found:
            if b[0] not in exact and all(a[2:]) and all(b[2:]) and a[2] == b[2] and abs(a[3] - b[3]) <= 0.1 and abs(a[4] - b[4]) <= 0.1:
                r = 100 * SequenceMatcher(None, a[1], b[1]).ratio()
                if r >= 50:
                    want.add((a[0], b[0], "LOCATION" if r >= 80 else "LOCATION_REVIEW", round(r, 6)))
    got = similar_strings.reconcile_by_place(spark.createDataFrame(known, schema), spark.createDataFrame(found, schema)).collect()
    assert {(r.known_id, r.found_id, r.match, round(r.confidence, 6)) for r in got} == want and len(got) == len(want)
    assert {m for _, _, m, _ in want} == {"EXACT", "LOCATION", "LOCATION_REVIEW"} or len(want) > 100

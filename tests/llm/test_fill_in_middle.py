"""Fill-in-middle against plain slicing of strings."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from annalum.llm import fill_in_middle as fim
from tests.llm.conftest import AWKWARD


def plain(doc_id, text):
    """The contract by decoded strings."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=700), max_size=12))
def test_rank_and_select(texts):
    data = "".join(texts).encode()
    starts = [i for i, c in enumerate(data) if c & 0xC0 != 0x80] + [len(data)]
    found = fim.Boundaries(np.frombuffer(data, np.uint8))
    assert found.select(np.arange(len(starts))).tolist() == starts
    at = np.arange(len(data) + 1)
    assert found.rank(at).tolist() == np.searchsorted(starts, at).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=300), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=9))
def test_cuts(rows):
    texts, one, other = zip(*rows, strict=True)
    n, low, high, a, b = fim.cuts([t.encode() for t in texts], np.array(one), np.array(other))
    for i, t in enumerate(texts):
        x, y = sorted((one[i] % (len(t) + 1), other[i] % (len(t) + 1)))
        assert (n[i], low[i], high[i]) == (len(t), x, y)
        assert (a[i], b[i]) == (len(t[:x].encode()), len(t[:y].encode()))


def test_slices(monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 10)
    assert list(fim._slices([])) == []
    assert list(fim._slices([4, 4, 4, 50, 0, 3, 10])) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]


def check(spark, docs):
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=repr) == sorted([(r.doc_id, *plain(r.doc_id, r.text)) for r in rows], key=repr)
    assert sorted(r.back for r in got) == sorted(r.text or "" for r in rows)
    return got


def test_documents(spark, data):
    got = check(spark, spark.read.parquet(f"{data}/documents.parquet"))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_awkward_rows(spark, awkward, nothing):
    assert len(check(spark, awkward)) == len(AWKWARD)
    assert fim.fill_in_middle(nothing).count() == 0
    texts = ["<P>", "a<S>b", "<M", "<P<S<M", "S>P>M>", "\U0001f600é<中" * 50, "a\0b\r\n", "x" * 2_000_000 + "é" * 1_000_000]
    check(spark, spark.createDataFrame([(i * 31 + j, t) for i, t in enumerate(texts) for j in range(12 if len(t) < 1000 else 2)], "doc_id long, text string"))


def test_other_markers(spark):
    docs = spark.createDataFrame([(i, "some text of words . with dots" * 3) for i in range(60)], "doc_id int, text string")
    markers = (".*", "[x]", "|")
    made = fim.fill_in_middle(docs, 100, 50, "s", markers)
    got = made.withColumn("back", fim.restored(made["output"], made["form"], markers)).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == "some text of words . with dots" * 3 for r in got)

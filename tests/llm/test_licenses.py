"""Licence scans against a plain scan of word lists."""

import re

import pytest

from annalum.llm import licenses as lic
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text, phrases=PHRASES):
    words = WORD.findall(lower(text or ""))
    hits = [(i, label) for phrase, label in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def check(docs):
    got = lic.summary(lic.scan(docs)).collect()
    rows = [(r.doc_id, *plain(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == sorted(rows, key=repr)
    for r in got:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    return got


def test_documents(spark, data):
    for sf in (data, data.replace("0.001", "0.01")):
        got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r.labels for r in got} == {"", "mit", "apache", "gpl", "cc-by-nc"}


def test_awkward_rows(spark, awkward, nothing):
    assert len(check(awkward)) == len(AWKWARD)
    assert lic.summary(lic.scan(nothing)).count() == 0
    texts = ["MIT License", "mit\n\nLICENSE!", "mitlicense", "summit license", "mit licenses", "MIT License MIT License mit mit license", "émit license", "mit license", "mit 1 license",
             "GNU General Public License and Apache License, MIT-License;general/public/license", "mit license" * 3, "x " * 300_000 + "MIT license", "mit license " * 50_000, "\0mit\x7flicense\0"]
    got = check(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, spans int"))
    assert {r.doc_id: r.n_base for r in got}[12] == 50_000


def test_notices_by_brute_force(spark):
    """Of the method's notices that start together the longest counts; all others count."""
    import random

    rng = random.Random(2)
    pieces = [*lic.NOTICES, *lic.BASE, "word", "cc", "by", "the", "public", "license"]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(300)]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        words = text.split()
        want = []
        for at in range(len(words)):
            fits = [p for p in lic.NOTICES if words[at : at + len(p.split())] == p.split()]
            want += [("notice", lic.NOTICES[max(fits, key=len)], at)] if fits else []
            want += [("base", x, at) for p, x in lic.BASE.items() if words[at : at + len(p.split())] == p.split()]
        assert sorted((s.kind, s.label, s.word) for s in got[i].spans) == sorted(want)


@pytest.mark.parametrize(("text", "terms", "duty", "named", "shown"), [
    ("MIT", "mit", 1, "mit", "MIT"),
    ("MIT OR GPL-3.0-only", "mit", 1, "gpl,mit", "MIT OR GPL-3.0-only"),
    ("GPL-2.0+ or MIT and Apache-2.0", "apache,mit", 1, "apache,gpl,mit", "GPL-2.0+ OR MIT AND Apache-2.0"),
    ("(GPL-2.0-only OR MIT) AND BSD-3-Clause", "bsd,mit", 1, "bsd,gpl,mit", "(GPL-2.0-only OR MIT) AND BSD-3-Clause"),
    ("AGPL-3.0-only AND MIT", "agpl,mit", 4, "agpl,mit", "AGPL-3.0-only AND MIT"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", 2, "gpl", "GPL-2.0-only WITH classpath-exception-2.0"),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR LGPL-2.1", "gpl", 2, "gpl,lgpl", None),
    ("MIT with the following", "mit", 1, "mit", "MIT"),
    ("MIT and other terms", "mit", 1, "mit", "MIT"),
    ("MIT AND (", "mit", 1, "mit", "MIT"),
    ("MIT AND ((and", "mit", 1, "mit", "MIT"),
    ("LicenseRef-Own OR MIT", "mit", 1, "licenseref-own,mit", None),
    ("CC-BY-NC-4.0 */", "cc-by-nc", 5, "cc-by-nc", "CC-BY-NC-4.0"),
    ("MIT.", "mit", 1, "mit", "MIT"),
    ("MIT\nAND GPL-2.0", "mit", 1, "mit", "MIT"),
    ("(" * 5000 + "MIT" + ")" * 5000, "mit", 1, "mit", None)])
def test_expressions(text, terms, duty, named, shown):
    found, form = lic.evaluate(text.encode())
    assert (",".join(sorted(found.licences)), found.duty, ",".join(sorted(found.named))) == (terms, duty, named)
    assert shown is None or form.replace("classpath", "Classpath") == shown.replace("classpath", "Classpath")


@pytest.mark.parametrize("text", ["", "(", "(MIT", "unknown", "AND MIT", ") MIT", "mitigation", "WITH", "((("])
def test_no_expressions(text):
    assert lic.evaluate(text.encode()) is None


def test_expressions_by_brute_force():
    """Random bracketed expressions against Python's own evaluation of the same tree."""
    import random

    rng = random.Random(4)
    names = ["MIT", "GPL-3.0-only", "LGPL-2.1", "AGPL-3.0", "CC-BY-NC-4.0", "CC0-1.0", "Apache-2.0"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            label = lic.licence(name)
            return name, (frozenset([label]), lic.DUTIES[label])
        op = rng.choice(["AND", "OR"])
        (a, (x, p)), (b, (y, q)) = tree(depth - 1), tree(depth - 1)
        value = (x | y, max(p, q)) if op == "AND" else ((x, p) if p <= q else (y, q))
        return f"({a} {op} {b})", value

    for _ in range(300):
        text, value = tree(5)
        found, _ = lic.evaluate(text.encode())
        assert (found.licences, found.duty) == value


def test_tags(spark):
    texts = ["/* SPDX-License-Identifier: MIT OR Apache-2.0 */ code", "# spdx license identifier: GPL-2.0-only WITH Linux-syscall-note", "License-Expression: (MIT)\nlicense expression MIT", "SPDX-License-Identifier MIT",
             "a\nSPDX-License-Identifier: BSD-2-Clause\nb\nSPDX-License-Identifier: ISC\n" * 200]
    got = {r.doc_id: r for r in check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    assert [got[i].labels for i in range(5)] == ["apache,mit", "gpl", "mit", "", "bsd,isc"]
    assert got[0].expressions == ["MIT OR Apache-2.0"] and got[1].expressions == ["GPL-2.0-only"] and got[3].expressions == []
    assert got[0].score == pytest.approx(1 - 0.1 * 0.1) and got[2].duty == 1
    spans = lic.scan(spark.createDataFrame([(0, texts[4])], "doc_id long, text string")).first().spans
    assert [s.word for s in spans if s.label == "isc"] == [12 * i + 8 for i in range(200)]

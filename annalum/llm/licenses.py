"""Licence scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for expressions.

A text is brought to words: A-Z in lower case, everything between words one blank. The automaton holds the phrases of
the notices and of the identifier tags, each between blanks, and reads the text once, however many phrases there are;
what it finds are places, counted in words. Behind a tag and a colon stands a licence expression. Its operators are
`with`, `and`, `or` in falling precedence, in capitals or small letters, and brackets nest to any depth, as the parser
keeps a stack of its own. An expression ends where it cannot go on: at a word that is neither operator nor licence,
at the end of the line, before an operator without a licence behind it. With an unclosed bracket it is not one.

An expression's value is what must be kept to: with `and` the stricter side and the licences of both, with `or` the
freer side, with `with` a linking exception softens a copyleft. Labels are all licences that a text names.

A task holds one batch, and of a text its bytes and its words as one string. Every row is judged alone.

Defined results: a null text is empty; without words n_words is 0 and nothing is found; places of one phrase and of
another count apart, and of the method's own notices that start together the longest counts; null ids are kept; rows
repeated in full are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import frugal, read, text_or_empty

# Phrases of the contract, phrases of well-known notices, tags, and licence families.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl", "boost software license": "boost",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "zlib license": "zlib",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under the apache license": "apache", "licensed under the mit license": "mit", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa", "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "released into the public domain": "public-domain", "dedicated to the public domain": "public-domain", "do what the fuck you want to public license": "wtfpl"}
TAGS = ("spdx license identifier", "license expression")
#: How much a licence asks: 0 nothing, 1 attribution, 2 weak copyleft, 3 copyleft, 4 copyleft over networks, 5 restricted.
DUTIES = {
    "public-domain": 0, "cc0": 0, "unlicense": 0, "0bsd": 0, "wtfpl": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "boost": 1, "cc-by": 1, "python": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2, "gpl": 3, "eupl": 3, "cc-by-sa": 3, "agpl": 4, "cc-by-nd": 5, "cc-by-nc": 5, "cc-by-nc-sa": 5, "cc-by-nc-nd": 5}
FAMILY = re.compile(r"(agpl|lgpl|gpl|apache|mit|bsd|isc|mpl|epl|cddl|eupl|zlib|unlicense|0bsd|wtfpl|cc0|cc-by-nc-sa|cc-by-nc-nd|cc-by-nc|cc-by-nd|cc-by-sa|cc-by|bsl|psf|python)(?=$|[-+0-9])")
RENAMED = {"bsl": "boost", "psf": "python"}
LINKING = ("classpath", "gcc", "llvm", "linking", "font", "bison", "autoconf", "openssl", "runtime")

#: Evidence that a text stands under a licence, by kind of place.
WEIGHT = {"base": 0.6, "notice": 0.6, "tag": 0.9}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_BLANKS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_RUN, _WORD = re.compile(rb" {2,}"), re.compile(rb"[^ ]+")
_OPENS = re.compile(rb"[ \t\"']*[:=][ \t\"']*")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


@dataclass(frozen=True)
class Terms:
    """The value of an expression: licences to keep to, what they ask, and all licences that it names."""

    licences: frozenset[str]
    duty: int
    named: frozenset[str]


def licence(identifier: str) -> str | None:
    """The label of an identifier; None if it is none."""
    low = identifier.lower()
    if low.startswith(("licenseref-", "documentref-")):
        return low
    found = FAMILY.match(low)
    return RENAMED.get(found[1], found[1]) if found else None


def _applied(op: str, a: Terms, b: Terms | str) -> Terms:
    if op == "with":
        softer = a.duty in (3, 4) and any(x in b for x in LINKING)
        return Terms(a.licences, 2 if softer else a.duty, a.named)
    if op == "and":
        return Terms(a.licences | b.licences, max(a.duty, b.duty), a.named | b.named)
    freer = a if a.duty <= b.duty else b
    return Terms(freer.licences, freer.duty, a.named | b.named)


def evaluate(text: bytes, at: int = 0) -> tuple[Terms, str] | None:
    """The expression that starts at a byte of text: its terms and itself in normal form; None if there is none."""
    ops: list[str] = []
    values: list[Terms | str] = []
    shown: list[str] = []
    brackets, operand_next = 0, True

    def reduce(least: int) -> None:
        while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= least:
            b = values.pop()
            values.append(_applied(ops.pop(), values.pop(), b))

    while found := _TOKEN.match(text, at):
        at, token = found.end(), found[1].decode("ascii")
        if operand_next:
            if token == "(" and not (ops and ops[-1] == "with"):
                ops.append("(")
                brackets += 1
            elif ops and ops[-1] == "with":
                if "exception" not in token.lower():
                    break
                values.append(token.lower())
                operand_next = False
            else:
                label = licence(token.rstrip(".:"))
                if label is None:
                    break
                token = token.rstrip(".:")
                values.append(Terms(frozenset([label]), DUTIES.get(label, 5), frozenset([label])))
                operand_next = False
            shown.append(token)
        elif token == ")" and brackets:
            reduce(1)
            ops.pop()
            brackets -= 1
            shown.append(token)
        elif token in ("and", "or", "with", "AND", "OR", "WITH"):
            op = token.lower()
            reduce(PRECEDENCE[op])
            if op == "with" and shown[-1] == ")":
                break
            ops.append(op)
            shown.append(op.upper())
            operand_next = True
        else:
            break
    if operand_next:  # an operator, or a bracket, without a licence behind it is not of the expression
        while ops and operand_next:
            brackets -= ops.pop() == "("
            shown.pop()
            operand_next = bool(shown) and shown[-1] in ("(", "AND", "OR", "WITH")
    if brackets or not values:
        return None
    reduce(1)
    return values[0], " ".join(shown).replace("( ", "(").replace(" )", ")")


def normal(text: bytes) -> bytes:
    """The words of a text, each between blanks; one blank if there is none."""
    return _RUN.sub(b" ", b" " + text.translate(_BLANKS) + b" ")


def automaton(base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    held: dict[str, list] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
        for phrase, label in phrases.items():
            held.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    for phrase, found in held.items():
        made.add_word(phrase, found)
    made.make_automaton()
    return made


def spans(text: bytes, found) -> tuple[int, list[dict]]:
    """The number of words, and the places: kind, label, word (from 0), words, and of tags terms, expression, duty."""
    words = normal(text)
    places = []
    for end, hits in found.iter(words.decode("latin-1")):
        places += [(end + 1 - size, -size, kind, label, n) for kind, label, size, n in hits]
    out: list[dict] = []
    begin = word = 0
    noticed, at, raw, past = -1, -1, None, 0
    for start, _, kind, label, n in sorted(places):
        word += words.count(b" ", begin, start)
        begin = start
        if kind == "notice":
            if noticed == start:
                continue
            noticed = start
        if kind != "tag":
            out.append({"kind": kind, "label": label, "word": word, "words": n, "terms": None, "expression": None, "duty": DUTIES[label]})
            continue
        raw = raw or _WORD.finditer(text.translate(_BLANKS))
        while at < word + n - 1:
            at, past = at + 1, next(raw).end()
        opened = _OPENS.match(text, past)
        value = evaluate(text, opened.end()) if opened else None
        if value:
            terms, shown = value
            for name in sorted(terms.named):
                out.append({"kind": kind, "label": name, "word": word, "words": n, "terms": ",".join(sorted(terms.licences)), "expression": shown, "duty": terms.duty})
    return words.count(b" ") - 1, out


SPAN = pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("terms", pa.string()), ("expression", pa.string()), ("duty", pa.int32())])


def _scanned(batches: Iterator[pa.RecordBatch], base: dict, notices: dict, tags: tuple) -> Iterator[pa.RecordBatch]:
    found = automaton(base, notices, tags)
    for batch in batches:
        rows = [spans(t.as_buffer().to_pybytes(), found) for t in batch.column(1)]
        columns = [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(SPAN))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans"])


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """doc_id, n_words, spans of every row of docs: spans are the places that name a licence, in their order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, spans array<struct<kind:string,label:string,word:long,words:int,terms:string,expression:string,duty:int>>"
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(frugal(partial(_scanned, base=base, notices=notices, tags=tags)), schema)


def _of(spans: Column, name: str) -> Column:
    return F.transform(spans, lambda s: s[name])


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of scan(): places and labels, a score (1 less the product of what each label's best place leaves open),
    the duties of the strictest place, and the expressions."""
    base = F.filter("spans", lambda s: s["kind"] == "base")
    pairs = F.array_distinct(F.transform("spans", lambda s: F.struct(s["label"].alias("label"), (s["kind"] == "tag").alias("tag"))))
    left = F.aggregate(F.array_distinct(_of(pairs, "label")), F.lit(1.0), lambda acc, x: acc * F.when(F.array_contains(pairs, F.struct(x.alias("label"), F.lit(True).alias("tag"))), 1 - WEIGHT["tag"]).otherwise(1 - WEIGHT["notice"]))
    words = _of(base, "word")
    expressions = F.array_distinct(F.filter(_of(F.col("spans"), "expression"), lambda x: x.isNotNull()))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        _joined(_of(base, "label")).alias("base_labels"), _joined(_of(F.col("spans"), "label")).alias("labels"), (1 - left).alias("score"),
        F.array_max(_of(F.col("spans"), "duty")).alias("duty"), expressions.alias("expressions"))


def query(spark, sf_dir: str) -> DataFrame:
    return summary(scan(read(spark, sf_dir, "documents").select("doc_id", "text")))

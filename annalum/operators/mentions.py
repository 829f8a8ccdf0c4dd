"""Names found in texts: all patterns at once, by an Aho-Corasick automaton.

The automaton reads a text once, however many names there are, and finds names inside names and names that overlap.
Names go to the tasks; a set of names of over `most_chars` characters is cut by a hash into parts, each of which is
an automaton of its own and a scan of the texts of its own, so that a task never holds more than one part.

Names and texts are compared in lower case. A name counts once for every place that does not overlap an earlier place of
the same name, as in a count from left to right; different names count apart. Null and empty names are nowhere, null
texts hold none, repeated rows of texts each give their rows, repeated names one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.operators.joins import first_columns

MOST_CHARS = 1_000_000


def _automaton(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, (name, len(name)))
    found.make_automaton()
    return found


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def counted(text: str, found, whole_words: bool = False) -> dict[str, int]:
    """Name -> number of places in text (in lower case); whole_words: only those that no letter or digit continues."""
    counts: dict[str, int] = {}
    past: dict[str, int] = {}
    for last, (name, size) in found.iter(text):
        begin, end = last + 1 - size, last + 1
        if begin < past.get(name, 0):
            continue
        if whole_words and ((begin and _is_word(text[begin - 1]) and _is_word(name[0])) or (end < len(text) and _is_word(text[end]) and _is_word(name[-1]))):
            continue
        past[name] = end
        counts[name] = counts.get(name, 0) + 1
    return counts


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], whole_words: bool) -> Iterator[pa.RecordBatch]:
    found = _automaton(names)
    for batch in batches:
        rows, out, n = [], [], []
        for i, text in enumerate(batch.column(0)):
            for name, k in counted(text.as_py(), found, whole_words).items():
                rows.append(i)
                out.append(name)
                n.append(k)
        keys = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.string()), pa.array(n, pa.int64())], [*batch.schema.names[1:], "name", "count"])


def name_counts(docs: DataFrame, keys: list[str], body: str, names: DataFrame, whole_words: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """keys, name (in lower case), count of every name that a text of docs holds. names: name."""
    spelled = names.select(F.lower("name").alias("name")).filter("name <> ''").distinct()
    parts = max(1, -(-(spelled.agg(F.sum(F.length("name"))).first()[0] or 0) // most_chars))
    texts = docs.filter(F.col(body).isNotNull()).select(F.lower(body).alias("_text"), *keys)
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    scans = []
    for part in range(parts):
        own = spelled if parts == 1 else spelled.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        some = sorted(r["name"] for r in own.collect())  # most_chars characters or about so many
        if some:
            scans.append(texts.mapInArrow(partial(_scan, names=some, whole_words=whole_words), f"{fields}, name string, count long"))
    if not scans:
        return docs.limit(0).select(*keys, F.lit("").alias("name"), F.lit(0).cast("long").alias("count"))
    return reduce(DataFrame.unionByName, scans)


def content_edges(texts: DataFrame, names: DataFrame, least_name: int = 5, least_text: int = 100) -> DataFrame:
    """from_kind, from_id, to_kind, to_id, count: whom a text about someone mentions, each pair once.

    texts: title, content. A text is about the person, else event, else place of that title; without one, or with under
    `least_text` characters, it gives nothing. names: kind, id, name; those under `least_name` characters are left out,
    of one kind's equal names the largest id stands. Nobody mentions itself; between people and between places an edge
    has the smaller id first, and the larger count of the two directions.
    """
    known = names.filter(F.length("name") >= least_name).groupBy("kind", F.lower("name").alias("name")).agg(F.max("id").alias("id"))
    rank = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "event", 1).otherwise(2)
    owner = first_columns(known.withColumn("_r", rank), ["name"], ["_r"], ["kind", "id"])
    own = owner.select(F.col("name").alias("_title"), F.col("kind").alias("from_kind"), F.col("id").alias("from_id"))
    about = texts.filter(F.length("content") >= least_text).join(own, F.lower("title") == F.col("_title")).select("from_kind", "from_id", "content")
    met = name_counts(about, ["from_kind", "from_id"], "content", known.select("name"))
    met = met.join(known.select("name", F.col("kind").alias("to_kind"), F.col("id").alias("to_id")), "name")
    met = met.filter((F.col("from_kind") != F.col("to_kind")) | (F.col("from_id") != F.col("to_id")))
    turn = (F.col("from_kind") == F.col("to_kind")) & (F.col("from_id") > F.col("to_id"))
    ends = met.select("from_kind", F.when(turn, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), "to_kind", F.when(turn, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), "count")
    return ends.groupBy("from_kind", "from_id", "to_kind", "to_id").agg(F.max("count").alias("count"))


def keyword_matches(books: DataFrame, key: str, body: str, keywords: DataFrame, least: int = 1) -> DataFrame:
    """figure, key, keywords, places: the books that hold at least `least` different keywords of a figure's list.
    keywords: figure, keyword."""
    listed = keywords.select("figure", F.lower("keyword").alias("name")).filter("name <> ''").distinct()
    met = name_counts(books, [key], body, listed.select("name")).join(listed, "name")
    return met.groupBy("figure", key).agg(F.count_distinct("name").alias("keywords"), F.sum("count").alias("places")).filter(F.col("keywords") >= least)

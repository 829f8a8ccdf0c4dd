"""Joins of strings by similarity, without comparing all pairs of a block.

Two strings of lengths x and y whose ratio (twice the longest common subsequence by x + y) is t or more have a common
subsequence of at least L = t (x + y) / 2 characters. Its L - 1 neighbouring pairs are pairs in both strings but for
one per character left out, so that the strings share at least 3 L - 1 - (x + y) of their two-character grams, counted
with repeats. Grams stand in one order, rare ones first; then two such strings share one among the first few of each:
those are the candidates' keys. Lengths must agree as well, and what is left is verified. Strings so short that no
shared gram is certain meet by their characters. Keys that many strings have are split into cells.

Short strings share most of their grams where they only count up, so they meet otherwise: two of lengths x and y have
a common subsequence of L characters just if leaving x - L characters out of one and y - L out of the other can give the same
string. Up to a length where that is MOST_VARIANTS strings at most for both, those are the keys, and they find no pair too many.

The bound holds from t = 0.7 on; the ratio of matching blocks (Ratcliff-Obershelp) is never above the one used here, so
the same candidates serve it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions.strings import ratio
from annalum.operators import pairs
from annalum.sources.shared import kept

BROADCAST_GRAMS, MOST_VARIANTS, LONGEST, PIECE = 200_000, 1000, 64, 50_000


def _tokens(s: Column, short: int) -> Column:
    """Two-character grams with the number of their repeat; of short strings the distinct characters as well."""
    n = F.length(s)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(F.array(grams), lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i), lambda y: y == x)).cast("string"))))[0]
    return numbered if not short else F.when(n <= short, F.concat(numbered, F.array_distinct(F.split(s, "")))).otherwise(numbered)


def _keys(strings: DataFrame, t: float, short: int) -> DataFrame:
    """s, token: the tokens by which a distinct string meets others."""
    cut = strings.select("s", F.posexplode(_tokens(F.col("s"), short)).alias("_at", "token")).withColumn("_is_char", F.length("token") == 1)
    cut = kept(cut.select("s", "token", "_is_char"), "grams")
    often = kept(cut.groupBy("token").agg(F.count("*").alias("_df")), "gram-counts")
    few = often.count() <= BROADCAST_GRAMS
    ranked = cut.join(F.broadcast(often) if few else often, "token").select("s", F.struct("_is_char", "_df", "token").alias("g"))
    grams = ranked.groupBy("s").agg(F.array_sort(F.collect_list("g")).alias("g"))  # a string's own grams, no more
    both = F.length("s") * 2 / (2 - t)  # the least sum of lengths; the bound grows with it
    shared = F.ceil((1.5 * t - 1) * both - 1 - 1e-9)
    own = F.filter("g", lambda p: ~p["_is_char"])
    prefix = F.slice(own, F.lit(1), F.greatest(F.least(F.size(own), F.size(own) - F.greatest(shared, F.lit(1)) + 1), F.lit(0)).cast("int"))
    chars = F.filter("g", lambda p: p["_is_char"])
    return grams.select("s", F.explode(F.transform(F.concat(prefix, chars), lambda p: p["token"])).alias("token"))


def _common(x: int, y: int, least: float) -> int:
    """How long a common subsequence must be."""
    return math.ceil(least * (x + y) / 2 - 1e-9)


def _variants(x: int, y: int, least: float) -> int:
    common = _common(x, y, least)
    return 0 if common > min(x, y) else math.comb(x, x - common) + math.comb(y, y - common)


def countable(least: float) -> int:
    """Strings of up to so many characters meet by what is left of them."""
    for y in range(1, LONGEST + 1):
        if any(_variants(x, y, least) > MOST_VARIANTS for x in range(1, y + 1)):
            return y - 1
    return LONGEST


def _rests(batches: Iterator[pa.RecordBatch], lengths: list[int], least: float) -> Iterator[pa.RecordBatch]:
    """s -> (s, own, other, rest): what can be left of s for partners of each length."""
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["s", "own", "other", "rest"])

    for batch in batches:
        for s in batch.column(0).to_pylist():
            x, by_size = len(s), {}
            for y in lengths:
                common = _common(x, y, least)
                if common <= min(x, y):
                    if common not in by_size:
                        by_size[common] = {"".join(c) for c in combinations(s, common)}
                    out += [(s, x, y, rest) for rest in by_size[common]]
            if len(out) >= PIECE:
                yield made()
    if out:
        yield made()


def _by_rests(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_s, b_s of short strings that have the ratio; a, b: s."""
    lengths = [sorted(r.n for r in df.select(F.length("s").alias("n")).distinct().collect()) for df in (a, b)]  # LONGEST at most
    if not all(lengths):
        return a.select(F.col("s").alias("a_s"), F.col("s").alias("b_s")).limit(0)
    rests = lambda df, partners: df.mapInArrow(partial(_rests, lengths=partners, least=least), "s string, own int, other int, rest string")
    left = kept(rests(a, lengths[1]).select("rest", F.col("own").alias("x"), F.col("other").alias("y"), F.col("s").alias("a_s")), "rests")
    right = kept(rests(b, lengths[0]).select("rest", F.col("other").alias("x"), F.col("own").alias("y"), F.col("s").alias("b_s")), "rests")
    return pairs.between(left, right, ["rest", "x", "y"], ["a_s"], ["b_s"]).select("a_s", "b_s")


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Distinct (a_s, b_s) of strings that can have a ratio of `least`, none missing. a, b: distinct s."""
    if not 0.7 <= least <= 1:
        raise ValueError("grams tell strings apart from a ratio of 0.7 on")
    short = math.ceil(1 / (1.5 * least - 1)) + 2  # longer ones share a gram for certain
    brief = F.length("s") <= countable(least)
    own = kept(a.select("s", F.lit(0).alias("_side")).unionByName(b.select("s", F.lit(1).alias("_side"))).filter("s <> ''"), "strings")
    at = lambda i: own.filter(F.col("_side") == i).select("s")
    keys = kept(_keys(own.select("s").distinct(), least, short), "string-keys")
    side = lambda df, name: keys.join(df, "s").select("token", F.col("s").alias(name))
    grams = lambda left, right: pairs.between(side(left, "a_s"), side(right, "b_s"), ["token"], ["a_s"], ["b_s"], spread=True)
    met = grams(at(0).filter(~brief), at(1)).unionByName(grams(at(0).filter(brief), at(1).filter(~brief)))
    alike = 2 * F.least(F.length("a_s"), F.length("b_s")) >= least * (F.length("a_s") + F.length("b_s")) - 1e-9
    # Changes of one character are at most as many as characters left out of either.
    changes = F.levenshtein("a_s", "b_s") <= (1 - least) * (F.length("a_s") + F.length("b_s")) + 1e-9
    met = met.filter(alike).filter(changes).select("a_s", "b_s")
    return met.unionByName(_by_rests(at(0).filter(brief), at(1).filter(brief), least)).distinct()


def similar(a: DataFrame, b: DataFrame, least: float, score=ratio) -> DataFrame:
    """a_s, b_s, ratio of all pairs of strings of at least `least`; two empty strings are alike, nulls to nothing.

    a, b: s, made distinct here. score: a function of two columns that is never above the ratio.
    """
    own = lambda df: df.select("s").filter("s is not null").distinct()
    met = candidates(own(a), own(b), least).withColumn("ratio", score("a_s", "b_s")).filter(F.col("ratio") >= least)
    empty = own(a).filter("s = ''").select(F.col("s").alias("a_s")).join(own(b).filter("s = ''").select(F.col("s").alias("b_s")), F.col("a_s") == F.col("b_s"))
    return met.unionByName(empty.withColumn("ratio", F.lit(1.0)))


def reconcile_by_place(known: DataFrame, found: DataFrame, sure: float = 80, doubtful: float = 50, apart: float = 0.1) -> DataFrame:
    """known_id, found_id, match, confidence: events of one year that are one event.

    EXACT: equal normalised titles (100). Of those found that have no exact match: within `apart` degrees in latitude and
    longitude, LOCATION from a title ratio of `sure` on, LOCATION_REVIEW from `doubtful` on. Rows without a year, or a
    coordinate or a year that is null or 0, have no place. Places meet by cells of a grid, so neither a year nor a cell
    is compared as a whole. known, found: id, title (normalised), year, latitude, longitude.
    """
    from annalum.operators.resolve import sequence_ratio

    first = known.select(F.col("id").alias("known_id"), F.col("title").alias("known_title"), F.col("year").alias("known_year"))
    second = found.select(F.col("id").alias("found_id"), F.col("title").alias("found_title"), F.col("year").alias("found_year"))
    exact = first.join(second, F.expr("known_title = found_title and known_year <=> found_year")).select("known_id", "found_id", F.lit("EXACT").alias("match"), F.lit(100.0).alias("confidence"))
    rest = found.join(exact.select(F.col("found_id").alias("id")).distinct(), "id", "left_anti")
    placed = lambda df: df.filter("latitude <> 0 and longitude <> 0 and year <> 0 and title is not null")
    row, col = F.floor(F.col("latitude") / apart).cast("long"), F.floor(F.col("longitude") / apart).cast("long")
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    left = placed(known).select("year", F.col("id").alias("known_id"), F.col("title").alias("known_title"), F.col("latitude").alias("known_lat"), F.col("longitude").alias("known_lng"), row.alias("row"), col.alias("col"))
    right = placed(rest).select("year", F.col("id").alias("found_id"), F.col("title").alias("found_title"), F.col("latitude").alias("found_lat"), F.col("longitude").alias("found_lng"), around(row).alias("row"), col.alias("_col"))
    right = right.withColumn("col", around(F.col("_col"))).drop("_col")
    met = pairs.between(left, right, ["year", "row", "col"], ["known_id", "known_title", "known_lat", "known_lng"], ["found_id", "found_title", "found_lat", "found_lng"])
    near = met.filter((F.abs(F.col("known_lat") - F.col("found_lat")) <= apart) & (F.abs(F.col("known_lng") - F.col("found_lng")) <= apart))
    titles = near.select("known_title", "found_title").distinct().filter("known_title <> '' and found_title <> ''")
    bound = 200 * F.least(F.length("known_title"), F.length("found_title")) / (F.length("known_title") + F.length("found_title"))
    scored = titles.filter(bound >= doubtful).withColumn("confidence", 100 * sequence_ratio("known_title", "found_title")).filter(F.col("confidence") >= doubtful)
    match = F.when(F.col("confidence") >= sure, "LOCATION").otherwise("LOCATION_REVIEW")
    return exact.unionByName(near.join(scored, ["known_title", "found_title"]).select("known_id", "found_id", match.alias("match"), "confidence"))

"""Entity resolution: matching in stages, decisions, fuzzy scores, merging, unifying sources."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from annalum.functions import scores, text
from annalum.operators.joins import blocked_pairs
from annalum.operators.windows import top_n


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1; 0 if either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity raised by a common prefix of up to four characters; 0 if either is null."""
    def jaro(s: str, t: str) -> float:
        if s == t:
            return 1.0
        reach = max(len(s), len(t)) // 2 - 1
        used, hits = [False] * len(t), []
        for i, c in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if not used[j] and t[j] == c:
                    used[j] = True
                    hits.append(c)
                    break
        if not hits:
            return 0.0
        moved = sum(x != y for x, y in zip(hits, [c for c, u in zip(t, used, strict=True) if u], strict=True)) / 2
        m = len(hits)
        return (m / len(s) + m / len(t) + (m - moved) / m) / 3

    def score(s, t) -> float:
        if s is None or t is None:
            return 0.0
        base, prefix = jaro(s, t), 0
        while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
            prefix += 1
        return base + prefix * 0.1 * (1 - base)

    return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def staged_match(queries: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, match_id, stage, confidence: by equal name (1.0), else by alias (0.95), else new (0). queries: id, name;
    names: id, name; aliases: entity_id, alias. Of several the smallest id."""
    exact = names.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("by_name"))
    alias = aliases.groupBy(F.lower("alias").alias("k2")).agg(F.min("entity_id").alias("by_alias"))
    out = queries.join(exact, F.lower("name") == F.col("k"), "left").join(alias, F.lower("name") == F.col("k2"), "left")
    stage = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return out.select("id", F.coalesce("by_name", "by_alias").alias("match_id"), stage.alias("stage"), F.when(F.col("by_name").isNotNull(), 1.0).when(F.col("by_alias").isNotNull(), 0.95).otherwise(0.0).alias("confidence"))


def decide(best: Column, second: Column, conflict: Column) -> Column:
    """Link above 0.85 unless a rival is above 0.8; doubtful from 0.6; else create. A conflict of ordinals creates."""
    return F.when(conflict, "CREATE").when((best > 0.85) & (F.coalesce(second, F.lit(0.0)) <= 0.8), "LINK").when(best > 0.6, "PENDING").otherwise("CREATE")


def _title_pairs(a: DataFrame, b: DataFrame, col: str, most_per_word: int | None = None, least: float = 0.0) -> DataFrame:
    """Distinct (a_name, b_name) of names without punctuation that share a word of three letters or more, and their ratio.
    Names are made distinct first, so that a frequent word costs by its names, not by its rows. Pairs whose lengths
    alone keep the ratio below `least` are left out before it is computed, unless one name holds the other."""
    plain = lambda df: df.select(text.unpunctuated(F.col(col)).alias("id")).distinct()
    key = F.filter(F.split("id", " "), lambda w: F.length(w) >= 3)
    pairs = blocked_pairs(plain(a), plain(b), key, key, most_per_word).select(F.col("a_id").alias("a_name"), F.col("b_id").alias("b_name"))
    if least:
        x, y = F.length("a_name"), F.length("b_name")
        pairs = pairs.filter((2 * F.least(x, y) >= least * (x + y)) | F.contains("a_name", "b_name") | F.contains("b_name", "a_name"))
    return pairs.withColumn("ratio", sequence_ratio("a_name", "b_name"))


def fuzzy_reconcile(a: DataFrame, b: DataFrame, auto: int = 85, review: int = 60, most_per_word: int | None = None) -> DataFrame:
    """Best match of each title in a among titles of b that share a word; score: 80% title, 20% year; without any, b_id is
    null and the score 0. a, b: id, title, year. `most_per_word` leaves frequent words out; None, the default, none."""
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), text.unpunctuated(F.col("title")).alias(f"{s}_name"), F.col("year").alias(f"{s}_year"))
    met = _title_pairs(a, b, "title", most_per_word).join(side(a, "a"), "a_name").join(side(b, "b"), "b_name")
    score = 80 * F.col("ratio") + 0.2 * F.coalesce(scores.year_proximity(F.col("a_year"), F.col("b_year")), F.lit(0))
    best = met.withColumn("score", F.round(score, 6)).groupBy("a_id").agg(F.max(F.struct("score", (-F.col("b_id")).alias("minus_b"))).alias("best"))
    out = a.select(F.col("id").alias("a_id")).join(best, "a_id", "left").select("a_id", (-F.col("best.minus_b")).alias("b_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"))
    return out.withColumn("decision", F.when(F.col("score") >= auto, "AUTO").when(F.col("score") >= review, "REVIEW").otherwise("NONE"))


def reconcile_top(a: DataFrame, b: DataFrame, n: int = 3, least: float = 40) -> DataFrame:
    """a_id, b_id, score, rank: the best n titles of b for each of a that share a word and score `least` or more.

    Titles weigh 70% and years 30%, titles all where a year is missing; equal years add 10, 100 at most. Ties go to the
    smallest id. No word is too frequent; titles without a common word do not meet. a, b: id, title, year.
    """
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), text.unpunctuated(F.col("title")).alias(f"{s}_name"), F.col("year").alias(f"{s}_year"))
    met = _title_pairs(a, b, "title").join(side(a, "a"), "a_name").join(side(b, "b"), "b_name")
    both = F.col("a_year").isNotNull() & F.col("b_year").isNotNull()
    near, title = scores.year_proximity(F.col("a_year"), F.col("b_year")), 100 * F.col("ratio")
    bonus = F.when(F.col("a_year") == F.col("b_year"), 10).otherwise(0)
    score = F.when(both, F.least(F.lit(100.0), 0.7 * title + 0.3 * near + bonus)).otherwise(title)
    good = met.select("a_id", "b_id", F.round(score, 6).alias("score")).filter(F.col("score") >= least)
    return top_n(good, ["a_id"], [F.desc("score"), F.asc("b_id")], n)


def best_person_match(a: DataFrame, b: DataFrame, least: float = 70) -> DataFrame:
    """a_id, b_id, score, kind for every person of a: the best of b with another id that shares a word of the name.

    Score: 60% of the name (100 equal, 90 one in the other, else the ratio; under 50 is no match) and up to 40 each for the
    years of birth and death. Below `least` b_id is null and kind 'new'. Ties go to the smallest id. a, b: id, name,
    birth_year, death_year.
    """
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), text.unpunctuated(F.col("name")).alias(f"{s}_name"), F.col("birth_year").alias(f"{s}_birth"), F.col("death_year").alias(f"{s}_death"))
    x, y = F.col("a_name"), F.col("b_name")
    named = _title_pairs(a, b, "name", least=0.5).withColumn("name", F.when(x == y, 100.0).when(F.contains(x, y) | F.contains(y, x), 90.0).otherwise(100 * F.col("ratio"))).filter("name >= 50")
    met = named.join(side(a, "a"), "a_name").join(side(b, "b"), "b_name").filter("a_id <> b_id")
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    points = lambda g: F.when(g == 0, 40).when(g <= 2, 30).when(g <= 5, 20).when(g <= 10, 10).otherwise(0)
    far = F.coalesce(gap("birth") > 10, F.lit(False)) | F.coalesce(gap("death") > 10, F.lit(False))
    life = F.when(far, 0).otherwise(points(gap("birth")) + points(gap("death")))
    kind = F.when((F.col("name") >= 95) & (life >= 20), "exact").when((F.col("name") >= 80) & (life >= 20), "fuzzy").when(life >= 20, "lifespan").otherwise("name_only")
    met = met.select("a_id", F.round(0.6 * F.col("name") + life, 6).alias("score"), (-F.col("b_id")).alias("minus_b"), kind.alias("kind"))
    best = met.groupBy("a_id").agg(F.max(F.struct("score", "minus_b", "kind")).alias("best"))
    out = a.select(F.col("id").alias("a_id")).join(best, "a_id", "left")
    found = F.coalesce(F.col("best.score") >= least, F.lit(False))
    return out.select("a_id", F.when(found, -F.col("best.minus_b")).alias("b_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"), F.when(found, F.col("best.kind")).otherwise("new").alias("kind"))


def repointed(edges: DataFrame, mapping: DataFrame, *cols: str) -> DataFrame:
    """edges with merged ids replaced and the copies that this makes removed. mapping: old_id, new_id."""
    out = edges
    for c in cols:
        m = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.distinct()


#: What is no name, whatever its case, and words that are none by themselves; Roman numbers of rulers.
NOISE = r"(?i)^([A-Z]|[0-9]+|[0-9]+\s*[&,]\s*[0-9]+|[A-Z]{2,4}|[0-9]+\s*(st|nd|rd|th))$"
NO_NAMES = (
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with", "mr", "mrs", "ms", "dr", "st", "ltd", "co", "inc", "son", "sons", "limited", "company", "brother", "brothers", "works", "factory",
    "street", "road", "lane", "square", "court", "place", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "oak", "ash", "elm", "pine", "walnut", "mahogany", "brass", "iron", "steel")
ROYAL = r"(?i)^(.{3,}?)\s+(I{1,3}|IV|VI{0,3}|IX|XI{0,3}|XIV|XV|XVI{0,3}|XIX|XX)$"


def tier1(rows: DataFrame) -> DataFrame:
    """Rules in order: noise, royal names apart, equal names merge into the one of most mentions, else pass. id, name,
    mentions. Names are equal in lower case, without outer blanks, with 'St.' and 'Mt.' written out and single blanks;
    noise and royal names do not take part in a merge. A null name passes."""
    name = F.trim("name")
    noise = (F.length("name") < 2) | (F.length("name") > 100) | name.rlike(NOISE) | F.lower(name).isin(*NO_NAMES) | ~F.col("name").rlike("[a-zA-Z]")
    base, ordinal = F.regexp_extract(name, ROYAL, 1), F.upper(F.regexp_extract(name, ROYAL, 2))
    royal = (F.length(F.trim(base)) >= 3) & (ordinal != "")
    written_out = F.regexp_replace(F.regexp_replace(name, r"\bSt\.\s*", "Saint "), r"\bMt\.\s*", "Mount ")
    key = F.trim(F.lower(F.regexp_replace(written_out, r"\s+", " ")))
    marked = rows.withColumn("_k", F.when(~noise & ~royal, key))
    best = marked.filter("_k is not null").groupBy("_k").agg(F.max(F.struct("mentions", (-F.col("id")).alias("minus"))).alias("best"), F.count("*").alias("_n"))
    out = marked.join(best, "_k", "left")
    rule = F.when(noise, "NOISE").when(royal, "SEPARATE").when(F.col("_n") > 1, "MERGE").otherwise("PASS")
    return out.select("id", rule.alias("rule"), F.when(rule == "MERGE", -F.col("best.minus")).otherwise(F.col("id")).alias("primary_id"), F.when(~noise & royal, F.trim(base)).alias("royal_base"))


def quality_label(verified: Column, name: Column, sourced: Column) -> Column:
    noisy = (F.length(name) < 3) | ~name.rlike(r"\p{L}")
    return F.when(verified, "verified").when(noisy, "noise").when(sourced, "sourced").otherwise("unverified")


def unify(**sources: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Sources of different schemas as one: a projection per source, columns that one lacks are null."""
    parts = [df.select(F.lit(name).alias("origin"), *[c.alias(k) for k, c in cols.items()]) for name, (df, cols) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def longest_per_key(rows: DataFrame, key: str, body: str) -> DataFrame:
    """The longest text of every key; the smaller text of equals."""
    return rows.filter(F.col(body).isNotNull()).groupBy(key).agg(F.min_by(body, F.struct(-F.length(body), F.col(body))).alias(body))


def _registered(entities: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """id, k, first_id, alias_id: an entity's key, the first owner of its name, the first that has it as an alias."""
    key = lambda c: F.lower(F.trim(c))
    out = entities.select("id", key("name").alias("k"))
    out = out.join(out.filter("k is not null").groupBy("k").agg(F.min("id").alias("first_id")), "k", "left")
    if aliases is None:
        return out.withColumn("alias_id", F.lit(None).cast("long"))
    return out.join(aliases.select(key("alias").alias("k"), "entity_id").groupBy("k").agg(F.min("entity_id").alias("alias_id")), "k", "left")


def _linked() -> tuple[Column, Column]:
    """(by name, by alias) of rows of _registered()."""
    again = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    return again, ~again & F.coalesce(F.col("alias_id") < F.col("id"), F.lit(False))


def registry_links(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, match_id, score, reason of what registry_decisions() links by an equal name (exact) or alias: two groupings, as
    candidates do not change these links, and no two names are compared."""
    again, known_as = _linked()
    found = _registered(entities, aliases).withColumn("reason", F.when(again, "exact").when(known_as, "alias")).filter("reason is not null")
    first = F.col("reason") == "exact"
    return found.select("id", F.when(first, F.col("first_id")).otherwise(F.col("alias_id")).alias("match_id"), F.when(first, 0.95).otherwise(0.9).alias("score"), "reason")


def registry_decisions(entities: DataFrame, least: float = 0.5, aliases: DataFrame | None = None) -> DataFrame:
    """id, match_id, score, decision, reason of every entity against those of smaller ids: the order of arrival is that of ids.

    An equal name (case and outer blanks aside) links to its first owner, 0.95; else an equal alias of an earlier entity
    to the first that has it, 0.90 (aliases: entity_id, alias). Else the candidates are earlier names that
    share a word of three letters with the name without its ordinal, have no other ordinal, and hold it, are held by it,
    or share over `least` of the characters; decide() judges the best two. Names are made distinct before they meet.
    A null name has no candidates. Ties go to the smallest id. entities: id, name.
    """
    key = F.lower(F.trim("name"))
    names = entities.filter("name is not null").groupBy(key.alias("k")).agg(F.min("id").alias("first_id"), F.min(F.trim("name")).alias("spelled"))
    base, ordinal = text.royal(F.col("spelled"))
    names = names.select(F.col("k").alias("id"), "first_id", ordinal.alias("ordinal"), F.lower(F.when(ordinal != "", base).otherwise(F.col("spelled"))).alias("base"))
    words = F.filter(F.split("base", r"\s+"), lambda w: F.length(w) >= 3)
    side = lambda p: names.select(*[F.col(c).alias(f"{p}_{c}") for c in names.columns])
    met = blocked_pairs(names, names, words, words).join(side("a"), "a_id").join(side("b"), "b_id").filter("b_first_id < a_first_id")
    met = met.filter("a_ordinal = '' or b_ordinal = '' or a_ordinal = b_ordinal")
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    met = met.withColumn("s", text.char_jaccard(bare("a_id"), bare("b_id")))
    met = met.filter((F.col("s") > least) | F.contains("b_id", "a_base") | F.contains("a_base", "b_id"))
    two = top_n(met.select("a_id", "b_first_id", "s"), ["a_id"], [F.desc("s"), F.asc("b_first_id")], 2)
    nth = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    judged = two.groupBy(F.col("a_id").alias("k")).agg(nth(1, "s").alias("best"), nth(2, "s").alias("second"), nth(1, "b_first_id").alias("near_id"))
    out = _registered(entities, aliases).join(judged, "k", "left")
    again, known_as = _linked()
    decision = F.when(again | known_as, "LINK").otherwise(decide(F.col("best"), F.col("second"), F.lit(False)))
    match = F.when(again, F.col("first_id")).when(known_as, F.col("alias_id")).when(decision == "LINK", F.col("near_id"))
    score = F.when(again, 0.95).when(known_as, 0.9).otherwise(F.coalesce("best", F.lit(0.0)))
    reason = F.when(again, "exact").when(known_as, "alias").when(F.col("near_id").isNotNull(), "near").otherwise("none")
    return out.select("id", match.alias("match_id"), score.alias("score"), decision.alias("decision"), reason.alias("reason"))


def five_stage_match(queries: DataFrame, names: DataFrame, aliases: DataFrame, keys: DataFrame, near: DataFrame, sure: float = 0.95, doubtful: float = 0.9) -> DataFrame:
    """id, match_id, stage, confidence: equal name (1.0), alias (0.95), outside key (0.98), nearest vector from `sure` on,
    a verified vector from `doubtful` on (both by their similarity), else none (0). Of several the smallest id.

    queries: id, name, key; names: id, name; aliases: entity_id, alias; keys: entity_id, key; near: id, match_id,
    similarity, verified, as many candidates of a query as can be its match; with a column `raw`, that decides whether a
    similarity is enough, and not the rounded one. Nulls match nothing.
    """
    first = lambda df, k, c, out: df.groupBy(k.alias(f"_{out}")).agg(F.min(c).alias(out))
    found = queries.join(first(names, F.lower("name"), "id", "by_name"), F.lower("name") == F.col("_by_name"), "left")
    found = found.join(first(aliases, F.lower("alias"), "entity_id", "by_alias"), F.lower("name") == F.col("_by_alias"), "left")
    found = found.join(first(keys, F.col("key"), "entity_id", "by_key"), F.col("key") == F.col("_by_key"), "left")
    nearest = lambda ok, out: F.max(F.when(ok, F.struct("similarity", (-F.col("match_id")).alias("minus")))).alias(out)
    raw = F.col("raw" if "raw" in near.columns else "similarity")
    best = near.groupBy("id").agg(nearest(raw >= sure, "surest"), nearest((raw >= doubtful) & F.col("verified"), "checked"))
    found = found.join(best, "id", "left")
    stages = [
        ("exact", F.col("by_name"), F.lit(1.0)), ("alias", F.col("by_alias"), F.lit(0.95)), ("key", F.col("by_key"), F.lit(0.98)),
        ("vector", -F.col("surest.minus"), F.col("surest.similarity")), ("verified", -F.col("checked.minus"), F.col("checked.similarity"))]
    stage = F.coalesce(*[F.when(m.isNotNull(), F.lit(name)) for name, m, _ in stages], F.lit("none"))
    confidence = F.coalesce(*[F.when(m.isNotNull(), c) for _, m, c in stages], F.lit(0.0))
    return found.select("id", F.coalesce(*[m for _, m, _ in stages]).alias("match_id"), stage.alias("stage"), confidence.alias("confidence"))


def match_confidence(name_score: Column, name_type: Column, lifespan: Column) -> tuple[Column, Column, Column]:
    """(confidence, reason, action) of a candidate from its name and its lifespan.

    name_type: exact, alias or fuzzy. lifespan: 0 to 1, null where a date is missing. A lifespan of 0 rejects any name,
    one to 0.3 leaves 0.4 of its score, none leaves the name alone, one from 0.8 on confirms exact names and aliases and
    lifts others by 0.15 to 0.95 at most, one between leaves 0.9. Actions: auto from 0.95, review from 0.6, low from 0.3.
    """
    lifted = F.least(name_score + 0.15, F.lit(0.95))
    sure = F.when(name_type == "exact", 1.0).when(name_type == "alias", 0.98).otherwise(lifted)
    sure_reason = F.when(name_type.isin("exact", "alias"), F.concat(name_type, F.lit("_lifespan_confirmed"))).otherwise("fuzzy_lifespan_boosted")
    cases = [
        (lifespan.isNull(), name_score, F.concat(name_type, F.lit("_no_lifespan_data"))),
        (lifespan == 0, F.lit(0.0), F.concat(name_type, F.lit("_but_lifespan_mismatch"))),
        (lifespan <= 0.3, name_score * 0.4, F.concat(name_type, F.lit("_lifespan_suspicious"))),
        (lifespan >= 0.8, sure, sure_reason)]
    confidence, reason = name_score * 0.9, F.concat(name_type, F.lit("_lifespan_partial"))
    for fits, value, why in reversed(cases):
        confidence, reason = F.when(fits, value).otherwise(confidence), F.when(fits, why).otherwise(reason)
    action = F.when(confidence >= 0.95, "auto").when(confidence >= 0.6, "review").when(confidence >= 0.3, "low").otherwise("none")
    return confidence, reason, action

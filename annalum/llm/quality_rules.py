"""Quality rules with thresholds that adapt to language and source (DataFrame functions only).

Rules look at shares that do not depend on length: symbols, repeated lines, words in repeated 8-word windows,
capitals, and the mean length of words. Their limits are not fixed: a mergeable quantile sketch of every share is
kept per (language, source), and the limit comes from its quantiles: for shares that every text has, `reach` times the
distance of the quartiles beyond them; for symbols, which most texts have none of, the quantile `TAIL` of all rows; for
repeated lines and windows the same of the rows that have any. Floors only keep a limit from having no width. The sketch
has a bucket per power of `base`, so its quantiles have a relative error of base - 1; sketches merge by adding counts, in
any order, with the same result. Merging gives the sketches of languages and of the whole corpus. A source's sketch is
merged with its language's, scaled to weigh `prior` rows, and a language's so with the corpus'. So small sources lean on
what is known of their language, large ones on themselves, and there is no size at which a limit jumps. Where the
corpus has no row to take a quantile of, there is no limit. Every row goes into a sketch; the tables of sketches and
fences have a few hundred rows per (language, source) at most and are joined back to the rows.

Within a text, repeated windows are found on an array of 64-bit hashes: only texts in which some hash repeats sort
it (n log n, in the row), so no word leaves its row and no text is shuffled.

Defined results: a null text has no words and fails the base rule; null language and source are groups of their own;
an empty table gives an empty result; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.llm.common import join_hot, read, small, text_or_empty, words, written


@dataclass(frozen=True)
class Rule:
    """reach: limits beyond the quartiles by so many times their distance; without, the limit is the quantile TAIL.
    some: over rows with a share above 0 only. floor: the least width, or the least limit of a tail."""

    reach: float | None = None
    below: bool = False
    some: bool = False
    floor: float = 1.0


RULES = {"symbols": Rule(floor=20.0), "dup_lines": Rule(some=True), "repeats": Rule(some=True), "capitals": Rule(reach=3.0), "word_length": Rule(reach=2.2, below=True)}
BASE, TAIL, PRIOR, UNITS, SYMBOLS = 1.05, 0.95, 20, 1000, "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
_WINDOWS = _let("transform(w, x -> xxhash64(x))", "g", "if(size(g) < 8, cast(array() as array<bigint>), transform(sequence(1, size(g) - 7), i -> xxhash64(slice(g, i, 8))))")
_REPEATED = "array_sort(transform(filter(s, (p, k) -> get(s, k - 1).h <=> p.h or get(s, k + 1).h <=> p.h), p -> p.i))"
_COVERED = _let("array_sort(transform(v, (h, i) -> struct(h as h, i as i)))", "s", _let(_REPEATED, "q", "aggregate(transform(q, (p, k) -> least(8, coalesce(get(q, k + 1) - p, 8))), 0, (a, x) -> a + x)"))
REPEAT_WORDS = _let(_WINDOWS, "v", f"if(size(array_distinct(v)) = size(v), 0, {_COVERED})")


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of every text and the shares that the rules judge, in thousandths (word_length: hundredths)."""
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    lines = F.expr(_let(r"filter(split(t, '\n'), l -> trim(both '\t\n\u000b\u000c\r ' from l) <> '')", "v", "struct(size(v) as n, size(v) - size(array_distinct(v)) as dup)"))
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("t"))
    rows = rows.select("doc_id", "lang", "source", without(SYMBOLS).alias("n_symbols"), without(CAPITALS).alias("n_capitals"), lines.alias("l"), words(F.col("t")).alias("w"))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.expr(REPEAT_WORDS).cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"), "n_capitals")
    share = lambda part, whole, scale=1000: F.expr(f"({scale} * {part}) div greatest({whole}, 1)")
    return rows.select(
        *rows.columns[:8], F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"), share("n_capitals", "word_chars").alias("capitals"), share("word_chars", "n_words", 100).alias("word_length"))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """A bucket's count per group and rule: the quantile sketches. Counts add up when sketches merge."""
    long = rows.select(*by, F.expr(f"stack({len(RULES)}, {', '.join(f"'{r}', {r}" for r in RULES)}) as (rule, x)"))
    bucket = F.when(F.col("x") <= 0, F.lit(0)).otherwise(1 + F.ceil(F.log("x") / F.log(F.lit(BASE)))).cast("int")
    return long.groupBy(*by, "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def blended(own: DataFrame, by: list[str], above: DataFrame, up: list[str], prior: int, everywhere: bool = False) -> DataFrame:
    """The sketches of groups, in units of a row's UNITS-th part, with those of `above` scaled to weigh `prior` rows.
    own: by, rule, bucket, n, with n 0 for groups that must not be missing."""
    share = F.floor(F.lit(float(prior * UNITS)) * F.col("n") / F.sum("n").over(W.partitionBy(*up, "rule"))).cast("long")
    parts = above.filter("n > 0").select(*up, "rule", "bucket", share.alias("n"))
    groups = own.select(*by, "rule").distinct()
    # Of the corpus there are at most some 900 buckets a rule.
    added = groups.join(F.broadcast(parts) if everywhere else small(parts), [*up, "rule"]).select(*by, "rule", "bucket", "n")
    return own.unionByName(added).groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], levels: tuple[float, ...] = (0.25, 0.75, TAIL)) -> DataFrame:
    """The quantiles q1, q2, ... per group and rule, each the upper end of its bucket."""
    up_to = F.sum("n").over(W.partitionBy(*by, "rule").orderBy("bucket"))
    all_n = F.sum("n").over(W.partitionBy(*by, "rule"))
    ranked = sketch.filter("n > 0").select("*", up_to.alias("up_to"), all_n.alias("all_n"))

    def value(level: float) -> Column:
        bucket = F.min(F.when(F.col("up_to") >= F.col("all_n") * level, F.col("bucket")))
        return F.when(bucket == 0, F.lit(0.0)).otherwise(F.pow(F.lit(BASE), bucket - 1))

    return ranked.groupBy(*by, "rule").agg(*[value(x).alias(f"q{i + 1}") for i, x in enumerate(levels)])


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """low, high per group and rule."""
    low = high = F.lit(None).cast("double")
    for name, rule in RULES.items():
        this = F.col("rule") == name
        if rule.reach is None:
            high = F.when(this, F.greatest("q3", F.lit(rule.floor))).otherwise(high)
            continue
        width = F.greatest(F.col("q2") - F.col("q1"), F.lit(rule.floor)) * rule.reach
        high = F.when(this, F.col("q2") + width).otherwise(high)
        if rule.below:
            low = F.when(this, F.col("q1") - width).otherwise(low)
    return quantiles(sketch, by).select(*by, "rule", low.alias("low"), high.alias("high"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang_key, source_key, n and <rule>_low, <rule>_high that hold there."""
    keys = ["lang_key", "source_key"]
    # Of rules over rows that have any, the rows that have none keep their group, without weight.
    some = F.col("rule").isin([name for name, rule in RULES.items() if rule.some])
    own = sketch.withColumn("n", F.when(some & (F.col("bucket") == 0), 0).otherwise(F.col("n") * UNITS))
    every = merged(own, [])
    lang = blended(merged(own, ["lang_key"]), ["lang_key"], every, [], prior, everywhere=True)
    limits = fences(written(blended(own, keys, lang, ["lang_key"], prior), "rules-blended"), keys)
    groups = sketch.groupBy(*keys, "rule").agg(F.sum("n").alias("n"))
    met = groups.join(limits, [*keys, "rule"], "left")
    of = lambda name, side: F.max(F.when(F.col("rule") == name, F.col(side))).alias(f"{name}_{side}")
    return met.groupBy(*keys).agg(F.max("n").alias("n"), *[of(name, side) for name in RULES for side in ("low", "high")])


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The base measures, base_failed, and kept: no base failure and no share beyond its limit."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = written(measures(docs).withColumns({"lang_key": key(F.col("lang")), "source_key": key(F.col("source"))}), "rules-measures")
    limits = written(thresholds(written(sketches(rows, ["lang_key", "source_key"]), "rules-sketches"), prior), "rules-fences")
    judged = join_hot(rows, limits, ["lang_key", "source_key"], "n", max(1, rows.count()))
    kept = ~F.col("base_failed")
    for name in RULES:
        kept = kept & F.coalesce(F.col(name) >= F.col(f"{name}_low"), F.lit(True)) & F.coalesce(F.col(name) <= F.col(f"{name}_high"), F.lit(True))
    return judged.withColumn("kept", kept)


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def blend(name: str, own: str, by: str, above: str, up: str) -> str:
        """A CTE: own sketches by `by` with those of `above` by `up`, scaled."""
        using = ", ".join([*up.split(", "), "rule"] if up else ["rule"])
        over = f"PARTITION BY {using}"
        return f"""
{name} AS (SELECT {by}, rule, bucket, sum(n) AS n FROM (SELECT {by}, rule, bucket, n FROM {own} UNION ALL
  SELECT {by}, rule, bucket, p.n FROM (SELECT DISTINCT {by}, rule FROM {own}) JOIN
    (SELECT {using}, bucket, floor({float(PRIOR * UNITS)}::DOUBLE * n / sum(n) OVER ({over}))::BIGINT AS n FROM {above} WHERE n > 0) p USING ({using})) GROUP BY ALL)"""

    quantile = lambda level: f"CASE WHEN min(bucket) FILTER (u >= a * {level}) = 0 THEN 0 ELSE pow({BASE}::DOUBLE, min(bucket) FILTER (u >= a * {level}) - 1) END"
    tails = " ".join(f"WHEN '{n}' THEN greatest(q3, {r.floor}::DOUBLE)" for n, r in RULES.items() if r.reach is None)
    highs = " ".join(f"WHEN '{n}' THEN q2 + greatest(q2 - q1, {r.floor}::DOUBLE) * {r.reach}::DOUBLE" for n, r in RULES.items() if r.reach)
    lows = " ".join(f"WHEN '{n}' THEN q1 - greatest(q2 - q1, {r.floor}::DOUBLE) * {r.reach}::DOUBLE" for n, r in RULES.items() if r.below)
    lang, both = "lang, ln", "lang, ln, source, sn"
    some = ", ".join(f"'{n}'" for n, r in RULES.items() if r.some)
    inside = " AND ".join(f"coalesce({r} >= low['{r}'], TRUE) AND coalesce({r} <= high['{r}'], TRUE)" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(lang, '') AS lang, lang IS NULL AS ln, coalesce(source, '') AS source, source IS NULL AS sn, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT i, unnest(list_transform(range(1, len(w) - 6), lambda k: {{'p': k, 'g': array_to_string(w[k : k + 7], ' ')}})) AS x FROM w WHERE len(w) >= 8),
f AS (SELECT i, unnest(list(x.p)) AS p FROM p GROUP BY i, x.g HAVING count(*) > 1),
r AS (SELECT i, count(DISTINCT x) AS n FROM (SELECT i, unnest(range(p, p + 8)) AS x FROM f) GROUP BY i),
b AS (SELECT w.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN r USING (i)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(len(l), 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals, 100 * word_chars // greatest(n_words, 1) AS word_length FROM b),
k AS (SELECT lang, ln, source, sn, rule, CASE WHEN x <= 0 THEN 0 ELSE 1 + ceil(ln(x) / ln({BASE}::DOUBLE)) END::INT AS bucket, count(*) AS n
        FROM (UNPIVOT (SELECT lang, ln, source, sn, {', '.join(f'{r}::BIGINT AS {r}' for r in RULES)} FROM m) ON {', '.join(RULES)} INTO NAME rule VALUE x) GROUP BY ALL),
ko AS (SELECT {both}, rule, bucket, CASE WHEN rule IN ({some}) AND bucket = 0 THEN 0 ELSE n * {UNITS} END AS n FROM k),
kl AS (SELECT {lang}, rule, bucket, sum(n) AS n FROM ko GROUP BY ALL),
ke AS (SELECT rule, bucket, sum(n) AS n FROM ko GROUP BY ALL),
{blend('bl', 'kl', lang, 'ke', '')},
{blend('bs', 'ko', both, 'bl', lang)},
q AS (SELECT {both}, rule, {quantile(0.25)} AS q1, {quantile(0.75)} AS q2, {quantile(TAIL)} AS q3 FROM
  (SELECT *, sum(n) OVER (PARTITION BY {both}, rule ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY {both}, rule) AS a FROM bs WHERE n > 0) GROUP BY ALL),
z AS (SELECT {both}, map_from_entries(list((rule, low))) AS low, map_from_entries(list((rule, high))) AS high FROM
  (SELECT g.*, CASE rule {lows} END AS low, CASE rule {tails} {highs} END AS high FROM (SELECT DISTINCT {both}, rule FROM k) g LEFT JOIN q USING ({both}, rule)) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM m JOIN z USING (lang, ln, source, sn)
"""


SQL = _sql()

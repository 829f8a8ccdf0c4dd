"""URL filters by a sort-merge range join of urls with (host, path) rules.

A host's labels, reversed and each closed by a separator below all others, make its canonical key: a host and all its
subdomains are an interval of keys, and intervals of rules are nested or apart. Urls and rules are cut into the same
ranges of keys, each range is sorted and swept once, and the sweep keeps a stack of the rules whose interval it is in.
The rules on the stack whose path starts the url's path fit; the longest wins.

Range boundaries are quantile keys of a sample of urls and decide only who sweeps what. They are pairs of key and page
id, so that one very common host, even one very common url, is cut into several ranges. A rule goes to every range that
its interval meets: a range has at most one chain of nested rules from outside. A task holds its stack and one batch.

Defined results: null urls and urls without `://` have empty host and path and no rule; they, and others that no rule
fits, get the default verdict; of equally long rules the one with the longer host wins, then the smaller; rules repeated
in full count once; an empty table gives an empty result; rows repeated in full are judged alike; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.llm.common import read, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT, URLS_PER_TASK, MOST_RANGES, SAMPLE, SEPARATOR = "allow", 250_000, 4096, 100, "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEPARATOR), F.lit(SEPARATOR))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows (pid, key, kind, page_id, host, path, rule, verdict) sorted by pid, key, kind; kind 0: a rule, 1: a url."""
    stack: list[tuple[str, list]] = []  # (key, rules of that host), from the outermost
    now = None
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for pid, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pid != now:
                now, stack = pid, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((host, path, verdict))
                continue
            fits = [(len(h) + len(p), len(h), h, p, v) for _, rules in stack for h, p, v in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
            best = min(fits, key=lambda x: (-x[0], -x[1], x[2:])) if fits else None
            for col, value in zip(out, (page_id, host, path, best[2] + best[3] if best else None, best[4] if best else default), strict=True):
                col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [batch.schema.field(3).type, *[pa.string()] * 4], strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def boundaries(keys: DataFrame, tasks: int, n: int) -> list[tuple[bytes, int]]:
    """Keys and salts that cut the urls into about `tasks` even ranges; SAMPLE rows a task are looked at."""
    if tasks < 2:
        return []
    some = keys.sample(fraction=min(1.0, SAMPLE * tasks / n), seed=7).limit(4 * SAMPLE * tasks).collect()
    ordered = sorted((r["key"].encode(), r["salt"]) for r in some)
    return sorted({ordered[len(ordered) * i // tasks] for i in range(1, tasks)}) if ordered else []


def _range_of(cuts: list[tuple[bytes, int]]):
    """(key, salt) -> how many boundaries are not above it, looked up in two steps. Keys compare by their bytes."""
    if not cuts:
        return lambda key, salt: F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    array = lambda row: "array(" + ",".join(f"named_struct('k', X'{k.hex()}', 's', cast('{s}' as bigint))" for k, s in row) + ")"
    heads, groups = F.expr(array([r[0] for r in rows])), F.expr("array(" + ",".join(map(array, rows)) + ")")

    def here(key: Column, salt: Column) -> Column:
        up_to = lambda bounds: F.size(F.filter(bounds, lambda c: (c["k"] < key.cast("binary")) | ((c["k"] == key.cast("binary")) & (c["s"] <= salt))))
        head = up_to(heads)
        return F.when(head == 0, F.lit(0)).otherwise((head - 1) * width + up_to(F.element_at(groups, F.greatest(head, F.lit(1)))))

    return here


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, tasks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url); rules: host, path, verdict."""
    host, path = host_and_path(F.col("url"))
    urls = written(pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"key": host_key(F.col("host")), "salt": F.xxhash64("page_id", "path")}), "url-keys")
    n = max(1, urls.count())
    tasks = tasks or min(MOST_RANGES, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // URLS_PER_TASK))
    cuts = boundaries(urls.select("key", "salt"), tasks, n)
    here = _range_of(cuts)
    lowest, highest = F.lit(-(2**63) + 1), F.lit(2**63 - 1)
    some_rules = rules.select("host", "path", "verdict").distinct().withColumn("key", host_key(F.col("host")))
    first, last = here(F.col("key"), lowest), here(F.concat(F.col("key"), F.lit("\U0010ffff")), highest)
    rule_rows = some_rules.withColumn("pid", F.explode(F.sequence(first, last))).select("pid", "key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict")
    url_rows = urls.select(here(F.col("key"), F.col("salt")).alias("pid"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    swept = url_rows.unionByName(rule_rows).repartition(max(1, len(cuts) + 1), "pid").sortWithinPartitions("pid", "key", "kind", "page_id")
    kind = pages.schema["page_id"].dataType.simpleString()
    return swept.mapInArrow(partial(_sweep, default=default), f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = f"""
WITH r(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT row_number() OVER () AS i, page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
h AS (SELECT i, page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN pos > 0 THEN regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') ELSE '' END AS path FROM u),
m AS (SELECT h.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY i ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, rh, rp, rv) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '{DEFAULT}') AS verdict FROM m WHERE k = 1
"""

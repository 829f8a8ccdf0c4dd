"""Search: BM25, vectors, rank fusion, substring and observation queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions import geo, text, years
from annalum.operators import vector_pairs
from annalum.operators.filters import contains, not_noise
from annalum.operators.mentions import name_counts
from annalum.sources.shared import kept

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """key, term, tf, doc_length. A null body has no tokens. Write it, partitioned or sorted by term, to search often."""
    own = docs.select(key, text.tokens(F.coalesce(body, F.lit(""))).alias("tokens"))
    return own.select(key, F.size("tokens").alias("doc_length"), F.explode("tokens").alias("term")).groupBy(key, "doc_length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, body: Column, terms: list[str], k: int | None = 20) -> DataFrame:
    """key, score of the best k documents; a term that the query repeats counts again.

    Only the query's terms are looked up: a document's tf of each is counted in its row, so no postings are shuffled;
    sums over the corpus are one row. The counts are written once, so texts are read and cut into tokens once.
    """
    unique = sorted(set(terms))
    toks = text.tokens(F.coalesce(body, F.lit("")))
    rows = docs.select(key, toks.alias("_t")).select(key, F.size("_t").alias("_n"), *[(F.size("_t") - F.size(F.array_remove("_t", F.lit(q)))).alias(f"_f{i}") for i, q in enumerate(unique)])
    rows = kept(rows, "counts")
    totals = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(unique))])
    idf = lambda i: F.ln((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
    part = lambda i: idf(i) * (F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))) * terms.count(unique[i])
    score = sum((part(i) for i in range(len(unique))), F.lit(0.0))
    found = rows.crossJoin(F.broadcast(totals)).filter(" or ".join(f"_f{i} > 0" for i in range(len(unique))) or "false").select(key, score.alias("score"))
    return found.orderBy(F.round("score", 9).desc(), F.asc(key)).limit(k) if k else found


def vector_topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, least: float) -> DataFrame:
    """The k most similar vectors of at least `least` cosine, by brute force in one pass."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.select(key, (dot / (size * F.lit(norm))).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.round("similarity", 9).desc(), F.asc(key)).limit(k)


def rrf(key: str, *ranked: DataFrame, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of short result lists (key, rank)."""
    union = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        union = union.unionByName(r.select(key, "rank"))
    return union.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def substring_search(df: DataFrame, query: str, *cols: str, with_noise: bool = True, name: str = "name") -> DataFrame:
    out = df.filter(contains(query, *[F.col(c) for c in cols]))
    return out if with_noise else out.filter(not_noise(F.col(name)))


def observe(events: DataFrame, locations: DataFrame, year: int, lat: float, lng: float, radius_km: float = 100.0) -> DataFrame:
    """Events under way in a year within a radius. A box in degrees goes first; it is pushed to the scan."""
    box = F.abs(F.col("latitude") - lat) <= radius_km / geo.DEGREE_KM * 1.01
    near = locations.filter(box).withColumn("km", geo.haversine(F.col("latitude"), F.col("longitude"), lat, lng)).filter(F.col("km") <= radius_km)
    return events.filter(years.active(F.col("date_start"), F.col("date_end"), year)).join(near.select(F.col("id").alias("location_id"), "km"), "location_id").select("id", "title", "date_start", "km")


def alive(persons: DataFrame, year: int, linked: DataFrame | None = None) -> DataFrame:
    """id, name of people alive in a year, noise excluded; linked (id): only those, which leaves orphans out."""
    there = persons.filter(not_noise(F.col("name")) & years.active(F.col("birth_year"), F.col("death_year"), year))
    return (there if linked is None else there.join(linked.select("id").distinct(), "id", "left_semi")).select("id", "name")


def embedding_text(title: Column, when: Column, where: Column, body: Column) -> Column:
    """Labelled lines; absent parts leave none."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))
    return F.concat_ws("\n", line("Title", title), line("Year", when), line("Location", where), line("Description", body))


def ngram_mentions(docs: DataFrame, key: str, body: Column, names: DataFrame, least: int = 1, most: int = 5, min_chars: int = 5) -> DataFrame:
    """Which names a document mentions as `least` to `most` words in a row; words are runs of a-z and 0-9 in lower case.

    Words stand between blanks, and so do names, so one automaton finds them in one pass, and no text is cut into n-grams.
    Names of under min_chars characters are left out. names: id, name."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    listed = names.select(F.col("id").alias("name_id"), F.trim(bare(F.col("name"))).alias("gram"))
    listed = listed.filter((F.length("gram") >= min_chars) & F.size(F.split("gram", " ")).between(least, most)).select("name_id", F.concat(F.lit(" "), "gram", F.lit(" ")).alias("name"))
    # Blanks are doubled in texts, so that of two names in a row each has its own.
    texts = docs.select(key, F.replace(F.concat(F.lit(" "), bare(F.coalesce(body, F.lit(""))), F.lit(" ")), F.lit(" "), F.lit("  ")).alias("_body"))
    spaced = listed.withColumn("name", F.concat(F.lit(" "), F.replace(F.trim("name"), F.lit(" "), F.lit("  ")), F.lit(" ")))
    return name_counts(texts, [key], "_body", spaced.select("name")).join(spaced, "name").select(key, "name_id").distinct()


def autocomplete(prefix: str, n: int, **tables: DataFrame) -> DataFrame:
    """The first n names of each type that contain the prefix, those that start with it first."""
    from annalum.operators.windows import top_n

    parts = [df.filter(contains(prefix, F.col("name"))).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name") for kind, df in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return top_n(union, ["kind"], [F.lower("name").startswith(prefix.lower()).desc(), F.asc("name"), F.asc("id")], n)


def similarity_pairs(vectors: DataFrame, key: str, block: str, vector: str, least: float) -> DataFrame:
    """Pairs of one block, a_id < b_id, of at least `least` cosine; large blocks are compared in cells."""
    return vector_pairs.within(vectors, key, block, vector, least)

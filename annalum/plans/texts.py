"""Texts cut and named: slugs, paragraphs, sections, first paragraphs; and the readers, over files derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalum.functions import python_only, text
from annalum.plans.catalog import query
from annalum.plans.queries import _long
from annalum.schema import Tables
from annalum.sources import files, shared

_TITLE = "trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))"


# ---- texts

@query(f"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(lower(strip_accents({_TITLE})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 200) AS slug FROM pages""")
def title_slugs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", python_only.ascii_slug(text.title(F.col("html"))).alias("slug"))


@query(f"""SELECT page_id, regexp_replace(trim(lower({_TITLE})), '\\s+', ' ', 'g') AS name FROM pages""")
def collapsed_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.collapsed(text.title(F.col("html"))).alias("name"))


@query("""SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: length(x) > 50)[1] AS paragraph FROM pages""")
def page_first_paragraphs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.first_paragraph(F.col("html")).alias("paragraph"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, E' \\t\\n\\r\\x0b\\x0c')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, string_split(list_reduce(p, lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + 2 + length(x) <= 1500 THEN a || E'\\n\\n' || x ELSE a || chr(1) || x END), chr(1)) AS pieces FROM p WHERE len(p) > 0)
SELECT doc_id, i::BIGINT AS piece, length(pieces[i + 1])::BIGINT AS chars, md5(pieces[i + 1]) AS digest FROM r, unnest(range(len(pieces))) u(i)""")
def packed_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of a document, packed in order into pieces of 1,500 characters."""
    each = t.documents.select("doc_id", F.posexplode(python_only.paragraphs("text")).alias("piece", "body"))
    return each.select("doc_id", *_long("piece"), F.length("body").cast("long").alias("chars"), F.md5("body").alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS body FROM conversations), g AS (SELECT conv_id, turn, length(body) AS n FROM s WHERE length(body) >= 500)
SELECT conv_id, 'CHAPTER ' || (turn + 1) AS heading, n::BIGINT AS chars FROM g
UNION ALL SELECT conv_id, '' AS heading, (sum(length('CHAPTER ' || (turn + 1)) + 1 + length(body) + 1) - 1)::BIGINT FROM s WHERE conv_id NOT IN (SELECT conv_id FROM g) GROUP BY 1 HAVING bool_and(body <> '')""")
def book_sections(t: Tables) -> DataFrame:
    """Conversations as books, a chapter a turn; chapters under 500 characters read as a table of contents."""
    turn = F.struct("turn", F.concat(F.lit("CHAPTER "), (F.col("turn") + 1).cast("string"), F.lit("\n"), F.trim(F.col("text"), F.lit(" \t\n\r"))).alias("page"), (F.trim(F.col("text"), F.lit(" \t\n\r")) == "").alias("blank"))
    books = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # a conversation's own turns
    whole = books.select("conv_id", F.array_join(F.transform("turns", lambda x: x["page"]), "\n").alias("book"), F.exists("turns", lambda x: x["blank"]).alias("blank"))
    found = whole.select("conv_id", "blank", F.explode(python_only.sections("book")).alias("s"))
    return found.filter("s.heading <> '' or not blank").select("conv_id", F.col("s.heading").alias("heading"), F.length("s.body").cast("long").alias("chars"))


# ---- readers

def _lines(t: Tables, lines: DataFrame, tag: str) -> str:
    path = shared.new_path(t.spark, tag)
    lines.write.text(path)
    return path


@query("SELECT id::BIGINT AS id, title, date_start::BIGINT AS year FROM event WHERE id % 50 <> 0")
def events_from_jsonl(t: Tables) -> DataFrame:
    """Events written as lines of JSON, of which some are broken, and read again without those."""
    line = F.to_json(F.struct(F.col("id"), "title", F.col("date_start").alias("year")))
    path = _lines(t, t.event.select(F.when(F.col("id") % 50 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")), "jsonl")
    return files.jsonl(t.spark, path, "id long, title string, year long")


@query("SELECT id::VARCHAR AS custom_id, title AS name, importance::BIGINT AS weight FROM event WHERE id % 7 <> 0")
def records_from_envelopes(t: Tables) -> DataFrame:
    """Answers of a batch in their envelopes; some have no content."""
    content = F.to_json(F.struct(F.col("title").alias("name"), F.col("importance").alias("weight")))
    message = F.struct(F.struct(F.when(F.col("id") % 7 != 0, content).alias("content")).alias("message"))
    answer = F.struct(F.col("id").cast("string").alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response"))
    path = _lines(t, t.event.select(F.to_json(answer).alias("value")), "envelopes")
    return files.envelopes(t.spark.read.text(path), "value", "name string, weight long")


@query("SELECT lower(trim(title)) AS name_normalized, min(id)::BIGINT AS id FROM event GROUP BY 1")
def gazetteer_from_tsv(t: Tables) -> DataFrame:
    """Tab-separated names, of each the first."""
    shown = F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.concat(F.lit(" "), "title"))
    path = _lines(t, t.event.select(F.concat_ws("\t", F.col("id").cast("string"), shown, F.coalesce("category", F.lit(""))).alias("value")), "tsv")
    return files.tsv_first_wins(t.spark, path, "id long, name string, kind string", "name", "id").select("name_normalized", "id")

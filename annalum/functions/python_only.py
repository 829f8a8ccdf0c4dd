"""The few functions that built-in expressions cannot say, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements without visible text, and those whose end ends a line.
HIDDEN = ("script", "style", "nav", "header", "footer", "aside", "sup", "sub")
LINE_ENDS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr")

_RAW = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*?(/?)>")


def visible_text(page: str | None) -> str:
    """One pass over the tags that are left once raw elements and comments are out: text under a hidden element is
    skipped, ends of blocks break the line, runs of blanks and blank lines shrink."""
    page, kept, hidden, at = _RAW.sub("", page or ""), [], 0, 0
    for tag in _TAG.finditer(page):
        if not hidden:
            kept.append(unescape(page[at : tag.start()]))
        at, name = tag.end(), tag.group(2).lower()
        ends, opens = bool(tag.group(1) or tag.group(3)), not tag.group(1)
        if name in HIDDEN:
            hidden = max(0, hidden + opens - ends)
        if ends and name in LINE_ENDS:
            kept.append("\n")
    if not hidden:
        kept.append(unescape(page[at:]))
    text = re.sub(r"\n\s*\n", "\n\n", "".join(kept))
    return re.sub(r"\n +", "\n", re.sub(r" +", " ", text)).strip()


def slug(title: str | None, most: int = 200) -> str:
    plain = unicodedata.normalize("NFKD", title or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:most]


@pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


@pandas_udf(StringType())
def ascii_slug(title: pd.Series) -> pd.Series:
    return title.map(slug)


PARAGRAPH_CHARS = 1500


@pandas_udf(ArrayType(StringType()))
def paragraphs(text: pd.Series) -> pd.Series:
    """Paragraphs packed in order into pieces of at most 1500 characters; a longer paragraph is a piece of its own."""

    def pack(t: str | None) -> list[str]:
        out: list[str] = []
        for p in (x.strip() for x in re.split(r"\n\s*\n", t or "")):
            if p and out and len(out[-1]) + 2 + len(p) <= PARAGRAPH_CHARS:
                out[-1] += "\n\n" + p
            elif p:
                out.append(p)
        return out

    return text.map(pack)


_HEADING = re.compile(r"(?m)^(?:(?:CHAPTER|BOOK|PART|ACT|SCENE|SECTION)\s+(?:[IVXLCDM]+|\d+)\b.*|[IVXLCDM]+\.\s+\S.*)$")


SECTION_CHARS = 500


@pandas_udf(ArrayType(StructType([StructField("heading", StringType()), StructField("body", StringType())])))
def sections(text: pd.Series) -> pd.Series:
    """A book's sections by its headings; bodies under 500 characters are lines of a table of contents."""

    def split(t: str | None) -> list[dict]:
        t = t or ""
        marks = [*_HEADING.finditer(t)]
        found = [{"heading": m.group().strip(), "body": t[m.end() : n].strip()} for m, n in zip(marks, [*(x.start() for x in marks[1:]), len(t)], strict=True)]
        found = [s for s in found if len(s["body"]) >= SECTION_CHARS]
        return found or ([{"heading": "", "body": t.strip()}] if t.strip() else [])

    return text.map(split)

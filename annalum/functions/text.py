"""Texts: normal forms, n-grams, chunks, HTML fields, keyword classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes and suffixes of names; the first that fits is cut.
TITLES = ("sir ", "king ", "queen ", "dame ", "lord ", "lady ", "prince ", "princess ", "emperor ", "empress ")
SUFFIXES = (" the great", " the brave", " the bold", " the fair", " of camelot", " of the lake", " of cornwall", " of orkney", " of britain", " of ireland", " de gaul")
#: Accented letters and their plain forms.
ACCENTED, PLAIN = "āēīōūáéíóúàèìòùäëïöüâêîôûñç", "aeiouaeiouaeiouaeiouaeiounc"


def collapsed(name: Column) -> Column:
    """Lower case, trimmed, single blanks."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def unpunctuated(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def folded(name: Column) -> Column:
    """Without accents."""
    return F.replace(F.translate(F.lower(name), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def place_key(name: Column) -> Column:
    """Without accents and punctuation, single blanks."""
    bare = F.regexp_replace(folded(name), r"[^\p{L}\p{N}_\x09-\x0D ]", " ")
    return F.trim(F.regexp_replace(bare, r"[\x09-\x0D ]+", " "))


def plain_name(name: Column) -> Column:
    """Lower case, without the first fitting title and the first fitting suffix."""
    low = F.trim(F.lower(name))
    first = lambda tests, base: reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(tests), base)
    low = first([(low.startswith(t), F.substring(low, F.lit(len(t) + 1), F.length(low))) for t in TITLES], low)
    return F.trim(first([(low.endswith(s), F.substring(low, F.lit(1), F.length(low) - len(s))) for s in SUFFIXES], low))


def royal(name: Column) -> tuple[Column, Column]:
    """(base, ordinal) of 'Louis XIV'; the ordinal needs white space before it, so 'Medici' has none."""
    pattern = r"^(.{3,}?)\s+([IVXLCDM]+)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def base_name(name: Column) -> Column:
    """Without a last Roman number to X or of X alone, then an Arabic ordinal, then 'the great', 'the elder', 'the younger'."""
    for last in (r"(?i)\s+(i{1,3}|iv|vi{0,3}|ix|x{1,3})$", r"(?i)\s+\d+(st|nd|rd|th)?$", r"(?i)\s+the\s+(great|elder|younger)$"):
        name = F.regexp_replace(name, last, "")
    return F.trim(name)


def word_ngrams(text: Column, least: int, most: int, min_chars: int = 5) -> Column:
    """Distinct n-grams of a text's words, joined by blanks, of at least min_chars."""
    def of(w: Column) -> Column:  # w: the words, bound once for all positions
        grams = lambda n: w if n == 1 else F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.filter(F.array_distinct(F.concat(*[grams(n) for n in range(least, most + 1)])), lambda g: F.length(g) >= min_chars)

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))), of)[0]


def tokens(text: Column) -> Column:
    """Search tokens: runs of a-z; of Hangul and of Kana and Han, each run's pairs and the run."""
    low = F.lower(text)
    pairs = lambda w: F.when(F.length(w) >= 2, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    runs = lambda pattern: F.flatten(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda w: F.concat(pairs(w), F.array(w))))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), runs("[\uac00-\ud7af]+"), runs("[\u3040-\u30ff\u4e00-\u9fff]+"))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of fixed size; the last reaches the end. Empty and null texts have none."""
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def classified(text: Column, classes: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The first class, in order, one of whose keywords is in the text."""
    low = F.lower(text)
    out = F.lit(default)
    for name, keywords in reversed(list(classes.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords]), F.lit(name)).otherwise(out)
    return out


def links(html: Column) -> Column:
    """Distinct targets of a page's links, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"#]+)'), 1))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))


def first_paragraph(html: Column, least: int = 50) -> Column:
    """The first paragraph of more than `least` characters, without tags; null if there is none."""
    bare = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", ""), r"\s+", " ")))
    return F.get(F.filter(bare, lambda p: F.length(p) > least), F.lit(0))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of sets of characters."""
    x, y = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def token_overlap(a: Column, b: Column) -> Column:
    """1.0 equal, 0.8 one in the other, 0.5 a shared word, else 0."""
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).when(F.arrays_overlap(F.split(a, r"\s+"), F.split(b, r"\s+")), 0.5).otherwise(0.0)

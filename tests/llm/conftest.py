import pytest

#: Rows that every operator has to take: nulls in any column, empty, long, tied and repeated ones.
AWKWARD = [
    (1, "the cat sat on the mat and the dog sat on the log", "en", "a"), (2, "", "en", "a"), (3, None, "en", "b"), (4, "the cat sat on the mat and the dog sat on the log", None, None),
    (None, "no id here", "en", "b"), (None, None, None, None), (5, "word " * 6000, "de", "b"), (6, " \t\n\x0b ", "de", "c"), (7, "ä ö <|endoftext|>  two  blanks\n \n\u00a0x", "de", "c"), (7, "ä ö <|endoftext|>  two  blanks\n \n\u00a0x", "de", "c"),
    (8, "the cat sat on the mat and the dog sat on the rug", "en", "c"), (9, "12 34 !!", "", ""), (10, "line one here\nline one here\nline two", "en", "a")]


@pytest.fixture(scope="session")
def awkward(spark):
    """AWKWARD with columns whose names clash with those that operators make."""
    rows = [(*r, 1, "x", 2.0, 3, True, "y") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key string, score double, n int, kept boolean, row string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

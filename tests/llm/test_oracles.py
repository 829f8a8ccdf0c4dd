"""Queries that SQL can express, against it."""

import pytest

from annalum.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, duck, name):
    names, expected = rows_of_sql(duck, ORACLE_SQL[name])
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql_on_awkward_rows(spark, awkward, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    awkward.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, "HTTP://WWW.Example.COM/en/x?q#f"), (2, None), (3, "no scheme"), (4, "a://example.com"), (5, "a://b.net/es/#/"), (5, "a://b.net/es/#/"), (None, "a://net/fr/"), (6, "x://com/?"), (7, "x://acom/"), (8, "x://www.example.com.evil.net/es/"), (9, "x://\n/y")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    one = [float(i) / 7 for i in range(64)]
    vectors = [(1, one), (1, one), (2, None), (3, []), (4, one[:63]), (5, [None, *one[1:]]), (6, [float("nan"), *one[1:]]), (7, [float("inf"), *one[1:]]), (None, [-x for x in one]), *((i, [x * i for x in one]) for i in range(8, 20))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names, expected = rows_of_sql(con, ORACLE_SQL[name])
    got = rows_of(QUERIES[name](spark, str(tmp_path)))
    if name == "op3_exact_dedup":  # of rows repeated in full exactly one stays, in SQL all; a null id is never the greatest
        at = names.index("kept")
        strip = lambda rows: sorted((r[:at] + r[at + 1 :] for r in rows), key=repr)
        assert strip(got) == strip(expected)
        assert sum(r[at] for r in got) == len({r[names.index("text_sha256")] for r in got})
    else:
        assert got == expected

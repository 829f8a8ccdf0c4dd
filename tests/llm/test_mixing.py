"""Ranks of large classes against the registered SQL."""

from annalum.llm import mixing
from tests.conftest import rows_of, rows_of_sql


def test_large_classes_match_sql(spark, tmp_path):
    """Over 1,000 rows in one class of sizes, most of one size, with null and repeated ids."""
    import duckdb

    rows = [(i * 7919 % 10007, "w " * (16 + i % 16 if i % 3 else 20), "a") for i in range(5000)]
    rows += [(i * 31 % 997, "w " * (1 + i % 40), "b" if i % 2 else None) for i in range(800)] + [(None, "w " * 20, "a")] * 3 + [(50, "w " * 20, "a")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names, expected = rows_of_sql(con, mixing.SQL)
    assert rows_of(mixing.query(spark, str(tmp_path))) == expected

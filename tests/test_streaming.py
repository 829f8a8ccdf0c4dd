"""Streams over small folders, drained to their end."""

import datetime as dt

from annalum.streaming import logs

START = dt.datetime(2024, 1, 1)


def folder(spark, path, rows):
    spark.createDataFrame(rows, "id long, user long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_ingests_every_row_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = folder(spark, src, [(1, 1, START), (2, 1, START)])
    logs.ingest(logs.log(spark, src, schema), out, mark).awaitTermination()
    folder(spark, src, [(3, 2, START)])
    logs.ingest(logs.log(spark, src, schema), out, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_counts_per_window(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = folder(spark, src, [(i, i % 2, START + dt.timedelta(minutes=25 * i)) for i in range(6)])
    got = logs.drained(logs.window_counts(logs.log(spark, src, schema), "ts", "user"), spark).collect()
    assert {(r.start.hour, r.user): r.n for r in got} == {(0, 0): 2, (0, 1): 1, (1, 1): 1, (1, 0): 1, (2, 1): 1}


def test_refuses_above_the_rate(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = folder(spark, src, [(i, 7, START + dt.timedelta(minutes=m)) for i, m in enumerate((0, 1, 2, 3, 70))] + [(9, 8, START)])
    q = logs.rate_limited(logs.log(spark, src, schema), "user", "ts", 2).writeStream.format("memory").queryName("refusals").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select user, minute(ts) + 60 * hour(ts) as m, refused from refusals").collect()
    assert {(r.user, r.m): r.refused for r in got} == {(7, 0): False, (7, 1): False, (7, 2): True, (7, 3): True, (7, 70): False, (8, 0): False}

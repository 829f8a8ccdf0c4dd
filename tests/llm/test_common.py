"""Tables in the shared folder are deleted when nothing reads them any more."""

import os

from annalum.llm import common


def there(df):
    return os.path.isdir(df.written_to)


def test_rewritten_and_settled_tables(spark):
    before = common.written(spark.range(5), "test-before")
    since = common.held()
    first = common.written(spark.range(10), "test-first")
    second = common.rewritten(first, first.selectExpr("id + 1 as id"), "test-second")
    assert not there(first) and there(second) and common.held() == since + 1
    third = common.written(second.filter("id > 3"), "test-third")
    last = common.settled(third.selectExpr("id * 2 as id"), "test-last", since)
    assert common.held() == since + 1 and there(last) and not there(second) and not there(third) and there(before)
    assert sorted(r.id for r in last.collect()) == [8, 10, 12, 14, 16, 18, 20] and before.count() == 5


def test_the_pipeline_keeps_one_table_a_stage(spark, data):
    import corpus_pipeline

    since = common.held()
    packed = corpus_pipeline.run(spark, data)
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._PATHS[since:]]
    assert names == ["pipeline-mixing", "packing-pieces"] and packed.count() > 0

"""Stages of the pipeline against brute force on a small table."""

import corpus_pipeline
from annalum.llm import exact_dedup, mixing, quality_classifier
from tests.llm.test_similar import slow_groups


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = exact_dedup.written(stage(spark, kept, data), f"test-{name}")
        assert kept.columns == docs.columns
        seen[name] = (before, kept.collect())
    before, after = seen["quality_classifier"]
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.learn(docs, labels)).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.5}
    good = {r.doc_id for r in labels.collect() if r.quality == 1} & {r.doc_id for r in before}
    assert len(good & {r.doc_id for r in after}) >= 0.95 * len(good)
    before, after = seen["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = seen["simhash_near_dedup"]
    expected = slow_groups({r.doc_id: r.text for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(expected.values()))
    before, after = seen["mixing"]
    source = exact_dedup.written(spark.createDataFrame(before, docs.schema), "test-mix")
    assert len(after) == sum(r.copies for r in mixing.mix(source).collect())
    packed = corpus_pipeline.packed(spark, kept, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in after}
    assert sum(r.piece == 0 for r in packed) == len(after)


def test_awkward_and_empty_tables(spark, awkward, nothing, data, tmp_path):
    """The whole run on rows with nulls, repeats and clashing names, and on no rows; rows without labels stay."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, docs in (("odd", awkward), ("none", nothing)):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in awkward.collect()}
    assert not {1, 2, 6, 8} & {r.doc_id for r in got}  # 4 and 3 are their copies
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []

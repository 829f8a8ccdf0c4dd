"""From raw documents to packed sequences: quality, copies, near-copies, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: a null text is empty everywhere; the classifier judges rows without an id like others; rows repeated in
full are copies, of which one stays; a null source is a source of its own in the mix; without labels nothing is
rejected; an empty table gives an empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalum.llm import exact_dedup, mixing, packing, quality_classifier, similar
from annalum.llm.common import held, read, settled


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    return quality_classifier.drop_bad(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest id."""
    return exact_dedup.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard of 0.8 or more): that of the smallest id."""
    return similar.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [("quality_classifier", good), ("exact_dedup", distinct), ("simhash_near_dedup", unlike), ("mixing", mixed), ("packing", packed)]

#: Tokens, XXH64 fingerprints and a fitted model are not in SQL: the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has kept in the shared folder goes when its result is written."""
    docs, since = read(spark, sf_dir, "documents"), held()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)

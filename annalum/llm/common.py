"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = "\t\n\x0b\x0c\r "
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Sides of a join with at most this many narrow rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only a local session may go without: it gets one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="annalum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is read column by column."""
    path = f"{shared_dir(df.sparkSession)}/annalum/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def rewritten(old: DataFrame, df: DataFrame, tag: str) -> DataFrame:
    """df, made from `old` (a written table), written; then old is deleted: nothing reads it any more."""
    made = written(df, tag)
    _PATHS.remove(old.written_to)
    _delete(df.sparkSession, old.written_to)
    return made


def held() -> int:
    """How many tables this process has in the shared folder: a mark for settled()."""
    return len(_PATHS)


def settled(df: DataFrame, tag: str, since: int) -> DataFrame:
    """df, written; then the tables written since the mark, of which df was made, are deleted."""
    made = written(df, tag)
    for path in _PATHS[since:-1]:
        _delete(df.sparkSession, path)
    del _PATHS[since:-1]
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows (counted here); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def release(spark: SparkSession) -> None:
    """Deletes the tables that this process has written to the shared folder. Results that read them must be saved first."""
    while _PATHS:
        _delete(spark, _PATHS.pop())


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back: Python workers live on from stage to stage, and what they hold
    counts against their executor. Buffers come from the system's allocator, and freed ones are returned at the end."""

    def run(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from task(batches)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than ASCII white space."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.coalesce(F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))), F.lit(0)).cast("long")


def hex_hash(col: Column, digits: int = 8) -> Column:
    """A hash that SQL engines share: the first hex digits of MD5, as a number."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, digits), 16, 10).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, most: int = 512) -> DataFrame:
    """rows left-joined with groups (unique on keys). weight sums to at most total over the groups, so fewer
    than `most` of them can hold more than total/most: those are broadcast, and their rows are not shuffled."""
    cut = total / most
    hot = F.broadcast(groups.filter(F.col(weight) > cut))
    rest = groups.filter(F.col(weight) <= cut)
    return rows.join(hot, keys, "inner").unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left"))


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the ids in dropped."""
    return docs.join(small(dropped.select(key)), key, "left_anti")

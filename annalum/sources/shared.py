"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may go without: it gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="annalum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unique() -> str:
    """A name that nothing else has."""
    return uuid.uuid4().hex


def fingerprint(df: DataFrame) -> str:
    """Of the files that df reads: their names, sizes and times of change."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    marks = []
    for name in sorted(df.inputFiles()):
        place = fs.Path(spark._jvm.java.net.URI(name))
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        marks.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()[:16]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else has; release() deletes it."""
    path = f"{folder(spark)}/annalum/{tag}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def kept(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written to the shared folder and read from there: rounds do not pile up lineage, lost executors cost nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this process has put there. Results that read it must be saved first."""
    conf = spark._jsc.hadoopConfiguration()
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)

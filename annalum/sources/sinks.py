"""Changes of tables, as functions of the old table and the new rows.

publish() adds a version of a table and current() reads the last complete one; replace() swaps plain folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.sources import shared


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of their key; columns in keep_old only fill what was null. new has one row per key."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_is_new"))
    both = old.withColumn("_is_old", F.lit(True)).join(n, keys, "full_outer")
    def value(c: str):
        if c in keys or c not in new.columns:
            return F.col(c)
        if c in keep_old:
            return F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c)
        return F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[value(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, one per key (the smallest by the other columns)."""
    others = [c for c in old.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*") if others else new.select(*keys).distinct()
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def compact(entities: DataFrame, *edges: tuple[DataFrame, str]) -> tuple[DataFrame, list[DataFrame]]:
    """Entities that some edge names, and edges whose entity is left."""
    named = edges[0][0].select(F.col(edges[0][1]).alias("id"))
    for df, c in edges[1:]:
        named = named.union(df.select(c))
    kept = entities.join(named.distinct(), "id", "left_semi")
    return kept, [df.join(kept.select(F.col("id").alias(c)), c, "left_semi") for df, c in edges]


def replace(df: DataFrame, path: str) -> None:
    """Writes df beside the table at path, then renames the old files away and the new ones into their place. Between the
    two renames there is no table; where readers must always find one, use publish()."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    new = f"{path}.new"
    df.write.mode("overwrite").parquet(new)
    conf = spark._jsc.hadoopConfiguration()
    target, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{path}.old"))
    fs = target.getFileSystem(conf)
    fs.delete(aside, True)
    if fs.exists(target):
        fs.rename(target, aside)
    if not fs.rename(fresh, target):
        raise OSError(f"cannot put {new} in place of {path}")
    fs.delete(aside, True)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    fs, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table's write has come to its end: the marker comes last, in one step."""
    fs, place = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(place)


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions under path and whether each is complete."""
    numbers = [int(n[1:]) for n in children(spark, path) if n[:1] == "v" and n[1:].isdigit()]
    return {n: finished(spark, f"{path}/v{n:09d}") for n in numbers}


def publish(df: DataFrame, path: str, number: int | None = None) -> int:
    """Writes df as the next version of the table at path, or as version `number`; readers see it once it is there, whole.

    It is written under a name of its own and then renamed, so of two writers of one number one fails and their files
    never mix. Returns the number.
    """
    spark = df.sparkSession
    n = number or max(_versions(spark, path), default=0) + 1
    fs, made = _at(spark, f"{path}/.new-{shared.unique()}")
    df.write.parquet(made.toString())
    _, target = _at(spark, f"{path}/v{n:09d}")
    if fs.exists(target) or not fs.rename(made, target):
        fs.delete(made, True)
        raise FileExistsError(f"version {n} of {path} is there already")
    return n


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of the table at path; a broken write is passed over."""
    done = [n for n, complete in _versions(spark, path).items() if complete]
    if not done:
        raise FileNotFoundError(f"no version of a table in {path}")
    return spark.read.parquet(f"{path}/v{max(done):09d}")


def publish_all(tables: dict[str, DataFrame], path: str, number: int | None = None) -> int:
    """Writes several tables as one version of the folder at path: readers see all of them before, or all after. One rename
    makes the version; a write that breaks off before it leaves nothing that a reader sees. Returns the number."""
    spark = next(iter(tables.values())).sparkSession
    n = number or max(_versions_of_all(spark, path), default=0) + 1
    fs, made = _at(spark, f"{path}/.new-{shared.unique()}")
    for name, df in tables.items():
        df.write.parquet(f"{made.toString()}/{name}")
    _, target = _at(spark, f"{path}/v{n:09d}")
    if fs.exists(target) or not fs.rename(made, target):
        fs.delete(made, True)
        raise FileExistsError(f"version {n} of {path} is there already")
    return n


def _versions_of_all(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:]) for n in children(spark, path) if n[:1] == "v" and n[1:].isdigit()]


def current_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last version that publish_all() made."""
    return spark.read.parquet(f"{path}/v{max(_versions_of_all(spark, path)):09d}/{name}")


def history_of(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of a table in all versions together, for versions that only add; None before the first."""
    found = [f"{path}/v{n:09d}/{name}" for n in sorted(_versions_of_all(spark, path))]
    return spark.read.parquet(*found) if found else None


def cascade(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[tuple[str, str, str, str]], start: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(rows left, rows deleted) of every table after rows are deleted with all that refers to them, to any depth.

    references: (child, its column, parent, its column); a table may refer to itself, and tables to each other in a
    circle. start: the first rows to go, by table, at least with its key columns. keys: the columns that tell a table's
    rows apart. A null reference refers to nothing. Rounds walk the references until nothing new goes; each writes the
    keys that it found, so no plan grows with the depth.
    """
    unknown = {name for child, _, parent, _ in references for name in (child, parent)} - tables.keys()
    if unknown:
        raise ValueError(f"references to unknown tables: {sorted(unknown)}")
    gone = {name: shared.kept(rows.select(*keys[name]).distinct(), "deleted") for name, rows in start.items()}
    last = dict(gone)
    while last:
        found: dict[str, DataFrame] = {}
        for child, column, parent, target in references:
            if parent not in last:
                continue
            ids = tables[parent].join(last[parent], keys[parent], "left_semi").select(F.col(target).alias(column)).distinct()
            hit = tables[child].join(ids, column, "left_semi").select(*keys[child])
            found[child] = found[child].union(hit) if child in found else hit
        last = {}
        for name, hit in found.items():
            hit = hit.distinct() if name not in gone else hit.distinct().join(gone[name], keys[name], "left_anti")
            hit = shared.kept(hit, "deleted")
            if not hit.isEmpty():
                last[name] = hit
                gone[name] = gone[name].union(hit) if name in gone else hit
    return {name: (df.join(gone[name], keys[name], "left_anti"), df.join(gone[name], keys[name], "left_semi")) if name in gone else (df, df.limit(0)) for name, df in tables.items()}


def json_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def unprocessed(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key the manifest of finished work lacks: a stopped run goes on from there."""
    return rows.join(manifest.select(key), key, "left_anti")

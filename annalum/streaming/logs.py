"""Logs as streams: checkpointed ingestion, counts per window, refusal above a rate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalum.sources import shared


def log(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A folder of files that only grows; its checkpoint remembers which are done."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None):
    """Every row once into Parquet at target: a batch that is repeated after a failure replaces its own files."""

    def write(batch: DataFrame, n: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window of event time and value of `by`; a window is final when the watermark passes it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def rate_limited(stream: DataFrame, key: str, time: str, limit: int, seconds: int = 3600) -> DataFrame:
    """Rows of a keyed stream marked `refused` where the last `seconds` of their key hold more than `limit`.

    The state of a key is the times of its rows within the last `seconds`, at most limit + 1 of them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(time)
            out = []
            for at in pdf[time].astype("datetime64[us]").astype("int64"):
                recent = [t for t in recent if t > at - seconds * 1_000_000][-limit:] + [at]
                out.append(len(recent) > limit)
            yield pd.DataFrame({key: pdf[key].to_numpy(), time: pdf[time].to_numpy(), "refused": out})
        state.update((recent,))

    return stream.select(key, time).groupBy(key).applyInPandasWithState(count, f"{key} {kind}, {time} timestamp, refused boolean", "recent array<bigint>", "append", GroupStateTimeout.NoTimeout)


def recent_counts(stream: DataFrame, key: str, time: str, row: str, limit: int, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """row, key, time, recent, refused: how many rows of its key the last `seconds` up to a row's second hold, and whether
    that is over `limit`; each once, when the watermark has passed its second, in whatever order rows arrived.

    State: of a key its rows that wait for the watermark, and counts by second within the window before it. A timer in
    event time takes waiting rows out and drops the key once its window has passed. Rows later than the watermark are
    not counted: Spark passes them over. Rows without a key or a time are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, time)}

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, micros, recent, times = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for pdf in [] if state.hasTimedOut else batches:
            ids += pdf[row].astype("int64").tolist()
            micros += pdf[time].astype("datetime64[us]").astype("int64").tolist()
        passed = state.getCurrentWatermarkMs() // 1000  # every row before this second is here
        waiting = sorted(zip(micros, ids, strict=True))
        done = [(t, i) for t, i in waiting if t // 1_000_000 < passed]
        rest = waiting[len(done) :]
        held = dict(zip(recent, times, strict=True))
        for t, _ in done:
            held[t // 1_000_000] = held.get(t // 1_000_000, 0) + 1
        out = [(i, t, sum(n for s, n in held.items() if t // 1_000_000 - seconds < s <= t // 1_000_000)) for t, i in done]
        held = {s: n for s, n in held.items() if s > passed - seconds}
        if rest or held:
            state.update(([i for _, i in rest], [t for t, _ in rest], list(held), list(held.values())))
            first = rest[0][0] // 1_000_000 + 1 if rest else max(held) + seconds
            state.setTimeoutTimestamp(max(first, passed + 1) * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({row: [i for i, _, _ in out], key: [keys[0]] * len(out), time: pd.to_datetime([t for _, t, _ in out], unit="us"), "recent": [n for _, _, n in out], "refused": [n > limit for _, _, n in out]})

    marked = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).select(F.col(row).cast("long").alias(row), key, time)
    out = f"{row} long, {key} {kinds[key]}, {time} {kinds[time]}, recent long, refused boolean"
    held = "ids array<bigint>, micros array<bigint>, seconds array<bigint>, counts array<bigint>"
    return marked.groupBy(key).applyInPandasWithState(count, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def drained(df: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """What a streaming aggregate holds after all files there are now, as a table in the shared folder."""
    at = shared.new_path(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")

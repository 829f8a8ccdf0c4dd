"""Sharding over fixed virtual slots (DataFrame functions only).

Records hash by doc_id into a fixed number of virtual slots. Bytes are summed per slot, before and after the
shuffle; that table has as many rows as there are slots, whatever the input, and is all that the driver sees.
A versioned slot-to-shard map gives slots to shards, at first largest first, each to the lightest shard. Versions lie
in the shared folder under the table's name, one small file each, never overwritten. The next run loads the latest one
and edits it: shards that were added take slots from the heaviest, slots leave shards that new loads have made too
heavy, no other slot moves; an edit that moves nothing makes no version. The query's law is `bytes`: shards hold nearly
equal bytes.

A record's place in its shard counts up without gaps: slots of a shard follow each other, and rows within a slot
are numbered by (doc_id, checksum, size). A slot holds 1/4096 of the rows, and no group of copies lands in one
slot, since copies differ in doc_id; only rows repeated in full share one.

Defined results: a null text has no bytes (size 1) and checksum 0; null ids hash as the empty string; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.llm.common import hex_hash, read, shared_dir, text_or_empty

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Shard of every virtual slot. Edits make a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def balanced(load: list[int], shards: int) -> SlotMap:
        heap = [(0, s) for s in range(shards)]
        shard_of = [0] * len(load)
        for slot in sorted(range(len(load)), key=lambda i: (-load[i], i)):
            now, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (now + load[slot], shard))
        return SlotMap(1, shards, tuple(shard_of))

    def loads(self, load: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += load[slot]
        return out

    def grown(self, load: list[int]) -> SlotMap:
        """One more shard: it takes slots from the heaviest shards until it has its share; no other slot moves."""
        to, have, shard_of = self.shards, self.loads(load), list(self.shard_of)
        share, taken = sum(load) / (self.shards + 1), 0
        for slot in sorted(range(len(load)), key=lambda i: (-load[i], i)):
            home = shard_of[slot]
            if load[slot] and taken + load[slot] <= share and have[home] - load[slot] >= share * 0.98:
                shard_of[slot], taken = to, taken + load[slot]
                have[home] -= load[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(shard_of))

    def rebalanced(self, load: list[int], slack: float = 0.01) -> SlotMap:
        """New loads, the same shards: slots leave shards above the mean by more than slack, one by one."""
        have, shard_of = self.loads(load), list(self.shard_of)
        mean = sum(load) / self.shards
        for slot in sorted(range(len(load)), key=lambda i: (-load[i], i)):
            home, to = shard_of[slot], min(range(self.shards), key=lambda s: (have[s], s))
            if load[slot] and have[home] > mean * (1 + slack) and have[to] + load[slot] < have[home]:
                shard_of[slot] = to
                have[home] -= load[slot]
                have[to] += load[slot]
        return SlotMap(self.version + 1, self.shards, tuple(shard_of))

    def edited(self, load: list[int], shards: int) -> SlotMap:
        """This map for new loads and at least as many shards; itself if nothing has to move."""
        if shards < self.shards:
            raise ValueError("shards are added, not taken away")
        new = self
        while new.shards < shards:
            new = new.grown(load)
        new = new.rebalanced(load)
        return self if new.shard_of == self.shard_of and new.shards == self.shards else SlotMap(self.version + 1, new.shards, new.shard_of)

    def store(self, spark: SparkSession, name: str) -> str:
        """Writes this version as one small JSON file; a version that is there is never overwritten."""
        path = f"{_folder(spark, name)}/v{self.version:06d}"
        row = json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of})
        spark.sql("select :row as value", args={"row": row}).write.mode("errorifexists").text(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> SlotMap:
        got = json.loads(spark.read.text(path).first()["value"])
        return SlotMap(got["version"], got["shards"], tuple(got["shard_of"]))

    @staticmethod
    def latest(spark: SparkSession, name: str, slots: int) -> SlotMap | None:
        """The last version under a name that was written whole; None if there is none of as many slots."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{_folder(spark, name)}/v*/_SUCCESS")
        done = path.getFileSystem(conf).globStatus(path) or []
        for at in sorted((f.getPath().getParent().toString() for f in done), reverse=True)[:1]:
            found = SlotMap.load(spark, at)
            return found if len(found.shard_of) == slots else None
        return None


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/annalum/slot-maps/{name}"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (hex_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % slots).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    load, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # `slots` rows at most
        load[r["vslot"]], count[r["vslot"]] = r["b"], r["n"]
    return load, count


def _lookup(values: list[int], slot: str = "vslot") -> Column:
    return F.element_at(F.expr(f"array({','.join(f'{v}L' for v in values)})"), F.col(slot) + 1)


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None, name: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot for every row. slot_map: the map to take; without, the latest version
    under `name`, edited and stored as the next one, or a balanced one where there is none."""
    rows = slotted(docs, slots)
    load, count = slot_loads(rows, slots)
    if slot_map is None:
        old = SlotMap.latest(docs.sparkSession, f"{name}-{slots}", slots) if name else None
        slot_map = old.edited(load, shards) if old else SlotMap.balanced(load, shards)
        if name and slot_map is not old:
            slot_map.store(docs.sparkSession, f"{name}-{slots}")
    begin, so_far = [0] * slots, [0] * slot_map.shards
    for v in range(slots):
        begin[v] = so_far[slot_map.shard_of[v]]
        so_far[slot_map.shard_of[v]] += count[v]
    place = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("slot", place - 1 + _lookup(begin)).withColumn("shard", _lookup(list(slot_map.shard_of)).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    table = "documents-" + hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    out = assign(read(spark, sf_dir, "documents").select("doc_id", "text"), 8, SLOTS, name=table)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: text_crc32 is left to the tests.
SQL = None

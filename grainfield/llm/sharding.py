"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes are added up per slot, and a small versioned table maps
slots to shards. Rebalancing edits that table (a few slots change their shard); records never rehash.

A slot that alone holds a fair part of a shard, as when one id has a third of all rows, cannot be balanced by moving it. The
map marks such slots as split, and their records are hashed anew with a salt of the row, over all slots.

Defined results: a null text has no bytes; null ids hash like the empty text; repeated rows are rows of their own; an empty
table gives a map and no rows. Ties of ids and texts are numbered in any order, as their rows are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import aside, cut, new_path

SLOTS = 8192
OVERHEAD = 16
#: A slot is split if it holds more than this part of a shard's mean.
HEAVY = 1 / 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def measured(records: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Written: the key, size, text_crc32, hashed slot and salt (a hash of the row's number) of each record."""
    size, crc = record_bytes(F.col(text)).alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32")
    return cut(records.select(F.col(key), size, crc, slot_of(F.col(key), slots).alias("hashed"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "sized")


def slot_bytes(rows: DataFrame, slot: Column) -> DataFrame:
    """(virtual_slot, bytes): combined map-side, so at most as many rows as there are slots leave each task."""
    return rows.groupBy(slot.alias("virtual_slot")).agg(F.sum("size").alias("bytes"))


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard table; its size is the number of slots, whatever the corpus."""

    version: int
    shards: int
    of: tuple[int, ...]
    note: str = ""
    split: frozenset[int] = frozenset()

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS, split: frozenset[int] = frozenset()) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)), "round robin", split)

    def slot(self, hashed: Column, salt: Column) -> Column:
        """The slot of a record: the one that its key hashes to, unless that one is split."""
        if not self.split:
            return hashed
        return F.when(hashed.isin(sorted(self.split)), F.pmod(F.xxhash64(hashed, salt), F.lit(len(self.of))).cast("int")).otherwise(hashed)

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, shard in enumerate(self.of):
            out[shard] += weights[s]
        return out

    def rebalanced(self, weights: list[int], tolerance: float = 0.001) -> SlotMap:
        """The next version: while the spread exceeds tolerance x mean, move the slot of the heaviest shard that best
        halves its gap to the lightest one, or swap two slots for that. Ties go to the smaller shard and slot."""
        of, loads = list(self.of), self.loads(weights)
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for s, shard in enumerate(of):
            held[shard].append(s)
        mean = sum(loads) / self.shards
        for _ in range(4 * len(of)):
            top = max(range(self.shards), key=lambda x: (loads[x], -x))
            low = min(range(self.shards), key=lambda x: (loads[x], x))
            gap = loads[top] - loads[low]
            if gap <= max(1, tolerance * mean):
                break
            out, back = _exchange(held[top], held[low], weights, gap)
            if out is None:
                break
            for s, a, b in ((out, top, low), (back, low, top)):
                if s is not None:
                    of[s] = b
                    held[a].remove(s)
                    held[b].append(s)
                    loads[a] -= weights[s]
                    loads[b] += weights[s]
        return SlotMap(self.version + 1, self.shards, tuple(of), "rebalanced", self.split)

    def grown(self, weights: list[int]) -> SlotMap:
        """The next version with one more shard: slots leave the heaviest shards and go only into the new one."""
        of, loads = list(self.of), [*self.loads(weights), 0]
        goal = sum(loads) / (self.shards + 1)
        by = [sorted((s for s, x in enumerate(of) if x == shard), key=lambda s: (weights[s], -s)) for shard in range(self.shards)]
        while loads[-1] < goal:
            top = max(range(self.shards), key=lambda x: (loads[x], -x))
            if not by[top] or loads[top] <= goal and loads[-1] > 0:
                break
            s = by[top].pop(len(by[top]) // 2)
            of[s] = self.shards
            loads[top] -= weights[s]
            loads[-1] += weights[s]
        return SlotMap(self.version + 1, self.shards + 1, tuple(of), "one more shard", self.split)

    def moved(self, other: SlotMap) -> list[int]:
        return [s for s, (a, b) in enumerate(zip(self.of, other.of, strict=True)) if a != b]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.version, self.shards, s, shard, s in self.split, self.note) for s, shard in enumerate(self.of)],
            "version int, shards int, virtual_slot int, shard int, split boolean, note string",
        ).coalesce(1)


def _exchange(top: list[int], low: list[int], weights: list[int], gap: int) -> tuple[int | None, int | None]:
    """A slot to move, and perhaps one to take back, so that the difference moved is nearest to half the gap."""
    best = min(((abs(gap - 2 * weights[s]), s) for s in top if 0 < weights[s] < gap), default=None)
    if best and best[0] <= gap // 2:
        return best[1], None
    import bisect

    mine, theirs = sorted(top, key=lambda s: (weights[s], s)), sorted(low, key=lambda s: (weights[s], s))
    have = [weights[s] for s in theirs]
    pair = None
    for s in mine:
        k = bisect.bisect_left(have, weights[s] - gap / 2)
        for j in (k - 1, k):
            if 0 <= j < len(theirs) and 0 < weights[s] - have[j] < gap:
                d = abs(gap - 2 * (weights[s] - have[j]))
                if pair is None or d < pair[0]:
                    pair = (d, s, theirs[j])
    if pair and (best is None or pair[0] < best[0]):
        return pair[1], pair[2]
    return (best[1], None) if best else (None, None)


def save_map(spark: SparkSession, versions: list[SlotMap], path: str | None = None) -> str:
    """Append versions to the map's table (partitioned by version) in the shared folder; returns its path."""
    path = path or new_path(spark, "slot-map")
    for m in versions:
        m.rows(spark).write.mode("append").partitionBy("version").parquet(path)
    return path


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many rows as slots
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), rows[0].note, frozenset(r.virtual_slot for r in rows if r.split))


def _weights(rows: DataFrame, slot: Column, slots: int) -> list[int]:
    weights = [0] * slots
    for r in slot_bytes(rows, slot).collect():  # at most `slots` rows
        weights[r.virtual_slot] = r.bytes
    return weights


def plan(rows: DataFrame, shards: int, slots: int = SLOTS, heavy: float = HEAVY) -> tuple[SlotMap, str, list[int]]:
    """Version 1 (round robin) and version 2 (rebalanced by bytes) for measured rows, saved; (current map, table path, bytes
    per slot)."""
    weights = _weights(rows, F.col("hashed"), slots)
    most = heavy * sum(weights) / shards
    one = SlotMap.first(shards, slots, frozenset(s for s, w in enumerate(weights) if w > most))
    if one.split:
        weights = _weights(rows, one.slot(F.col("hashed"), F.col("salt")), slots)
    two = one.rebalanced(weights)
    path = save_map(rows.sparkSession, [one, two])
    return two, path, weights


def assign(rows: DataFrame, current: SlotMap, path: str, key: str = "doc_id") -> DataFrame:
    """Each measured record's size, text_crc32, virtual_slot, shard and place (`slot`, gapless from 0 within its shard).

    Places: counts per (virtual slot, part) are summed into offsets, rows are numbered inside one part only. Parts split
    a virtual slot by the row's salt, so no task orders a whole shard."""
    spark = rows.sparkSession
    rows = rows.withColumns({"virtual_slot": current.slot(F.col("hashed"), F.col("salt")), "part": F.pmod(F.hash("salt"), F.lit(16))})
    mapped = spark.read.parquet(path).where(F.col("version") == current.version).select("virtual_slot", "shard")  # a row for each slot
    numbered = rows.join(F.broadcast(mapped), "virtual_slot")
    parts = numbered.groupBy("shard", "virtual_slot", "part").count()  # at most 16 x slots rows
    before = F.sum("count").over(W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut(parts.select("virtual_slot", "part", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    inside = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy(F.col(key), "text_crc32", "size", "salt")) - 1
    return (
        numbered.withColumn("inside", inside)
        .join(F.broadcast(offsets), ["virtual_slot", "part"])
        .select(key, "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), "virtual_slot")
    )


def shard(records: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """All records with their places under law `bytes`: sizes of shards are near equal, whatever ids and texts repeat."""
    own, names = aside(records)
    rows = measured(own, names[key], names[text], slots)
    current, path, _ = plan(rows, shards, slots)
    placed = assign(rows, current, path, names[key]).withColumnRenamed(names[key], key)
    return placed.withColumn("map_version", F.lit(current.version))

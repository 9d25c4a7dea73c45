"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots; the hash covers its
id and its text, so neither a missing nor an often repeated id makes a slot hot.
Bytes and rows are summed per slot, and a map from slots to shards is stored
with a version. The first version deals the slots, largest first, to the
lightest shard. A later one is an edit of the one before: only as many slots
move as are needed to even out the bytes, all others keep their shard. Nothing
but the map (``SLOTS`` rows) and the slot sums reach the driver.

Defined results: a null text has size 1 and crc32 0, like an empty one; full
copies of one record share a slot; repeated ids are dealt by their texts; an
empty table gets a map without bytes; other columns of the input are kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quibble.sources.staging import new_folder, stage

SLOTS = 4096
SEED = 5


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col(key), F.coalesce(F.col(text), F.lit(""))), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]  # per slot


def first_map(loads: list[int], shards: int) -> SlotMap:
    """Largest slot first, each to the shard with fewest bytes (the lowest number on a tie)."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        held, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (held + loads[slot], s))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, loads: list[int], shards: int, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave removed and overfull shards only, largest that fits first."""
    shard_of = list(old.shard_of)
    fair = sum(loads) / shards
    held = [0] * shards
    loose = []
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot, s in enumerate(shard_of):
        if s < shards:
            held[s] += loads[slot]
            members[s].append(slot)
        else:
            loose.append(slot)
    for s in range(shards):
        for slot in sorted(members[s], key=lambda i: (-loads[i], i)):
            if held[s] <= fair * (1 + tolerance):
                break
            if loads[slot] and held[s] - loads[slot] >= fair * (1 - tolerance):
                held[s] -= loads[slot]
                loose.append(slot)
    heap = [(held[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda i: (-loads[i], i)):
        b, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (b + loads[slot], s))
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def store_map(spark: SparkSession, m: SlotMap, folder: str) -> DataFrame:
    """Add a version to the maps in ``folder``; a version is written once and never changed."""
    rows = [(m.version, m.shards, slot, s) for slot, s in enumerate(m.shard_of)]
    frame = spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1)
    path = f"{folder}/version={m.version}"
    frame.drop("version").write.mode("error").parquet(path)
    return spark.read.schema("shards int, virtual_slot int, shard int").parquet(path)


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per slot of records with ``virtual_slot`` and ``size``."""
    loads = [0] * slots
    for slot, b in records.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        loads[slot] = b
    return loads


def assign(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``docs`` whole, with size, virtual_slot, shard and map_version; texts are read twice and never shuffled."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("size", "virtual_slot", "shard", "map_version")]
    sized = docs.select(*[f"`{c}`" for c in kept], record_size().alias("size"), virtual_slot(slots=slots).alias("virtual_slot"))
    m = first_map(slot_loads(sized, slots), shards)
    stored = store_map(spark, m, folder or new_folder(spark, "slot-map")).drop("shards")
    mapped = sized.join(F.broadcast(stored), "virtual_slot")
    return mapped.select(*[f"`{c}`" for c in kept], "size", "virtual_slot", "shard", F.lit(m.version).alias("map_version"))


def shard(
    docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None, old: SlotMap | None = None
) -> DataFrame:
    """``docs`` without text, with size, text_crc32, virtual_slot, shard, map_version and ``slot``, the place in its shard.

    Places are dealt without ordering a shard: rows are staged with the number of their task and
    their place in it, and counts per task and shard (one row each) give the offsets.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ("text", "size", "text_crc32", "virtual_slot", "shard", "slot", "map_version", "_part", "_at")
    kept = [c for c in docs.columns if c not in added]
    staged = stage(
        docs.select(
            *[f"`{c}`" for c in kept],
            record_size().alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            virtual_slot(slots=slots).alias("virtual_slot"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "records",
    )
    loads = slot_loads(staged, slots)
    m = rebalanced(old, loads, shards) if old else first_map(loads, shards)
    stored = store_map(spark, m, folder or new_folder(spark, "slot-map"))
    mapped = staged.join(F.broadcast(stored.drop("shards")), "virtual_slot")
    counts = mapped.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", "shard").orderBy("_at")
    placed = mapped.withColumn("_row", F.row_number().over(within)).join(offsets, ["shard", "_part"])
    return placed.select(
        *[f"`{c}`" for c in kept], "size", "text_crc32", "virtual_slot", "shard",
        (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(m.version).alias("map_version"),
    )

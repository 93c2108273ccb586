"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots; the bytes of each slot are summed, and a
versioned table maps slots to shards. Rebalancing edits the map: it moves slots from the heaviest
shard to the lightest, or exchanges two, until no move makes the shards more equal, and stores a new
version. Only the
map (one row per slot, so its size is fixed) goes through the driver and is broadcast.

Defined cases: a null or empty text has size 1; rows that repeat an id are dealt by id and text
together, each keeping a place of its own, and only exact copies of one row share a slot; rows with a
null id, which names nobody, are dealt by their place in the input; an empty table gives an empty result and an even
map. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

#: Virtual slots; fixed for the life of a data set, far above any number of shards.
SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each document."""
    text = F.coalesce("text", F.lit(""))
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text, row), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, combined before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt to shards in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owners: list[int], weights: list[int], shards: int) -> list[int]:
    """``owners`` edited until no move brings the heaviest and the lightest shard closer.

    Where no slot can move alone, two are exchanged, down to a thousandth of the mean load. Slots of shards that no longer exist are dealt first; a grown number of shards starts empty.
    Every move shrinks the squared sum of loads, so the loop ends.
    """
    owners = list(owners)
    loads = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, owner in enumerate(owners):
        if owner < shards:
            loads[owner] += weights[slot]
            members[owner].add(slot)
    for slot in sorted((s for s, o in enumerate(owners) if o >= shards), key=lambda s: -weights[s]):
        owners[slot] = to = loads.index(min(loads))
        loads[to] += weights[slot]
        members[to].add(slot)
    while True:
        heavy, light = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[heavy] - loads[light]
        slot = min((s for s in members[heavy] if 0 < weights[s] < gap), key=lambda s: (abs(gap - 2 * weights[s]), s), default=None)
        swap = None
        if slot is None:
            if gap * shards * 1000 <= sum(loads):
                return owners  # within a thousandth of the mean
            pairs = ((s, t) for s in members[heavy] for t in members[light] if 0 < weights[s] - weights[t] < gap)
            best = min(pairs, key=lambda p: (abs(gap - 2 * (weights[p[0]] - weights[p[1]])), p), default=None)
            if best is None:
                return owners
            slot, swap = best
        for moved, source, target in ((slot, heavy, light), (swap, light, heavy)):
            if moved is not None:
                members[source].discard(moved)
                members[target].add(moved)
                owners[moved] = target
                loads[source] -= weights[moved]
                loads[target] += weights[moved]


@dataclass
class SlotMap:
    """Versions of a slot-to-shard map, one Parquet folder each under ``path``."""

    spark: SparkSession
    path: str

    def save(self, version: int, owners: list[int]) -> None:
        rows = self.spark.createDataFrame(list(enumerate(owners)), "virtual_slot int, shard int")
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")

    def owners(self, version: int) -> list[int]:
        return [r["shard"] for r in self.load(version).orderBy("virtual_slot").collect()]

    def edit(self, version: int, loads: DataFrame, shards: int) -> int:
        """Store and return the version after ``version``, balanced by the bytes of ``loads``."""
        owners = self.owners(version)
        weights = [0] * len(owners)
        for r in loads.collect():  # one row per slot at most
            weights[r["virtual_slot"]] = r["bytes"]
        self.save(version + 1, rebalanced(owners, weights, shards))
        return version + 1


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, place``; shards near equal in bytes.

    ``place`` numbers the rows of a shard from 0 without gaps: slots follow one another, and only
    the rows of one slot are numbered together.
    """
    spark = docs.sparkSession
    rows = materialize(records(docs, slots), "records")
    loads = slot_loads(rows)
    store = SlotMap(spark, f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    store.save(0, even_map(shards, slots))
    current = store.load(store.edit(0, loads, shards))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = current.join(F.broadcast(loads), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("first")
    )
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("n", F.row_number().over(in_slot))
        .join(F.broadcast(first), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("place"))
    )

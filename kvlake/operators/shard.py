"""Hash-slot sharding: the slot map, routing, owner-filtered scans and slot migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.functions.hashing import slot
from kvlake.model import DELETE, SLOTS

from .log import number_by_key
from .read import key_range, latest_live


def initial_map(spark: SparkSession, groups: list[int]) -> DataFrame:
    """Slots dealt in turn to the sorted groups, epoch 1; without groups every slot is unassigned (0)."""
    ordered = sorted(groups)
    owner = F.element_at(F.array(*[F.lit(g).cast("long") for g in ordered]), (F.col("id") % len(ordered)).cast("int") + 1) if ordered else F.lit(0).cast("long")
    return spark.range(SLOTS).select(F.lit(1).cast("long").alias("epoch"), F.col("id").cast("int").alias("slot"), owner.alias("group_id"), F.lit(False).alias("migrating"))


def with_slot(shards: DataFrame, at: int, group_id: int) -> DataFrame:
    return with_slots(shards, [at], group_id)


def with_slots(shards: DataFrame, slots: list[int], group_id: int) -> DataFrame:
    """Move slots and end their migration; the epoch goes up."""
    here = F.col("slot").isin(slots)
    return shards.select(
        (F.col("epoch") + 1).alias("epoch"),
        "slot",
        F.when(here, F.lit(group_id).cast("long")).otherwise(F.col("group_id")).alias("group_id"),
        (F.col("migrating") & ~here).alias("migrating"),
    )


def with_migrating(shards: DataFrame, at: int, migrating: bool = True) -> DataFrame:
    """Mark or unmark a slot as migrating; the epoch goes up."""
    flag = F.when(F.col("slot") == at, F.lit(migrating)).otherwise(F.col("migrating"))
    return shards.select((F.col("epoch") + 1).alias("epoch"), "slot", "group_id", flag.alias("migrating"))


def with_reassign(shards: DataFrame, old: int, new: int) -> DataFrame:
    """Give all slots of one group to another; migration marks stay; the epoch goes up."""
    owner = F.when(F.col("group_id") == old, F.lit(new).cast("long")).otherwise(F.col("group_id"))
    return shards.select((F.col("epoch") + 1).alias("epoch"), "slot", owner.alias("group_id"), "migrating")


def adopt(maps: DataFrame) -> DataFrame:
    """Of several maps the one with the highest epoch."""
    top = maps.agg(F.max("epoch").alias("_top"))
    return maps.join(F.broadcast(top), F.col("epoch") == F.col("_top")).drop("_top").distinct()


def groups_of(shards: DataFrame) -> DataFrame:
    return shards.where("group_id <> 0").select("group_id").distinct()


def slots_of(shards: DataFrame) -> DataFrame:
    """Sorted slots of each group."""
    return shards.groupBy("group_id").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def route(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Add ``slot``, ``owner`` and ``migrating`` by key. The map has 256 rows, so it is broadcast."""
    m = shards.select(F.col("slot").alias("_slot"), F.col("group_id").alias("owner"), "migrating")
    return rows.withColumn("slot", slot(F.col("key"))).join(F.broadcast(m), F.col("slot") == F.col("_slot"), "left").drop("_slot")


def owned(placed: DataFrame, shards: DataFrame) -> DataFrame:
    """Copies of ops (group_id and op) that lie with their slot's owner."""
    return route(placed, shards).where("group_id = owner").drop("owner", "migrating")


def cluster_scan(placed: DataFrame, shards: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int | None = None) -> DataFrame:
    """Live pairs of all groups in key order, stray copies left out."""
    live = latest_live(owned(placed.where(key_range(start, end, empty_end_is_open=True)), shards))
    ordered = live.select("key", "value").orderBy("key")
    return ordered if limit is None else ordered.limit(limit)


def group_scan(placed: DataFrame, group_id: int, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """All live pairs that lie in one group, whoever owns their slots."""
    held = placed.where((F.col("group_id") == group_id) & key_range(start, end, empty_end_is_open=True))
    return latest_live(held).select("key", "value").orderBy("key")


def classify_writes(writes: DataFrame, shards: DataFrame) -> DataFrame:
    """Add ``verdict``: empty_key, unassigned, migrating, wrong_group (if the write names another group than the owner) or ok."""
    routed = route(writes, shards)
    verdict = F.when(F.octet_length("key") == 0, F.lit("empty_key")).when(F.coalesce("owner", F.lit(0)) == 0, F.lit("unassigned")).when(F.col("migrating"), F.lit("migrating"))
    if "routed_group" in writes.columns:
        verdict = verdict.when(F.col("routed_group") != F.col("owner"), F.lit("wrong_group"))
    return routed.withColumn("verdict", verdict.otherwise(F.lit("ok")))


def copy_slots(placed: DataFrame, slots: list[int], source: int, target: int, after: bytes | None = None, seq: int | None = None) -> DataFrame:
    """Puts that bring the live pairs of slots after a key from one group to another, with their slot: one pass over the source."""
    held = placed.where(F.col("group_id") == source)
    if after is not None:
        held = held.where(F.col("key") > F.lit(after))
    if seq is not None:
        held = held.where(F.col("seq") <= seq)
    live = latest_live(held.withColumn("slot", slot(F.col("key"))).where(F.col("slot").isin(slots)))
    return live.withColumn("group_id", F.lit(target).cast("long"))


def copy_slot(placed: DataFrame, at: int, source: int, target: int, after: bytes | None = None, seq: int | None = None) -> DataFrame:
    """Puts that bring a slot's live pairs after a key from one group to another."""
    return copy_slots(placed, [at], source, target, after, seq).drop("slot")


def copy_cursor(copied: DataFrame, *by: str) -> DataFrame:
    """Where to go on: the last key and how many were copied, of all or of each slot."""
    return copied.groupBy(*by).agg(F.max("key").alias("last_key"), F.count(F.lit(1)).alias("copied"))


def clear_slots(placed: DataFrame, slots: list[int], group_id: int, next_seq: int) -> DataFrame:
    """Tombstones for the live pairs that a group has of slots, numbered from ``next_seq`` in key order."""
    live = latest_live(placed.where((F.col("group_id") == group_id) & slot(F.col("key")).isin(slots))).select("key")
    numbered = number_by_key(live, next_seq)
    return numbered.select(F.lit(group_id).cast("long").alias("group_id"), "seq", "key", F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("value"))


def clear_slot(placed: DataFrame, at: int, group_id: int, next_seq: int) -> DataFrame:
    return clear_slots(placed, [at], group_id, next_seq)


def migrate_slots(placed: DataFrame, shards: DataFrame, slots: list[int], source: int, target: int, next_seq: int) -> tuple[DataFrame, DataFrame]:
    """Copy, flip, clear: the placed ops and the map afterwards.

    Copies are new puts, numbered from ``next_seq`` (above all numbers so far), and the source's tombstones
    follow them, so that a slot can move back. What the target holds of the slots before is stray: copies
    are newer, and pairs that the source lacks get tombstones. Nothing changes before the
    result is used; freeze writes with ``with_migrating`` meanwhile, and lift that should the move fail.
    Slots that are the target's already are only cleared, whatever the source still holds of them; a slot
    of a third group is an error.
    """
    if source == target:
        raise ValueError(f"group {source} is source and target")
    owners = {r.slot: r.group_id for r in shards.where(F.col("slot").isin(slots)).select("slot", "group_id").collect()}  # 256 rows at most
    if strange := [s for s in slots if owners.get(s) not in (source, target)]:
        raise ValueError(f"slots {strange} are not group {source}'s")
    columns = ["group_id", "seq", "key", "kind", "value"]
    placed = placed.select(columns)
    moving = [s for s in slots if owners[s] == source]
    copies = copy_slots(placed, moving, source, target).select("key", "kind", "value")
    strays = copy_slots(placed, moving, target, target).select("key").join(copies.select("key"), "key", "left_anti")
    gone = strays.select("key", F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("value"))
    moved = number_by_key(copies.unionByName(gone), next_seq).withColumn("group_id", F.lit(target).cast("long"))
    cleared = moved.where(F.col("kind") != DELETE).withColumn("group_id", F.lit(source).cast("long")).withColumn("seq", F.col("seq") + F.col("total")).withColumn("kind", F.lit(DELETE).cast("tinyint")).withColumn("value", F.lit(None).cast("binary"))
    after = placed.unionByName(moved.select(columns)).unionByName(cleared.select(columns))
    if left := [s for s in slots if s not in moving]:
        after = after.unionByName(clear_slots(placed, left, source, next_seq).select(columns))
    return after, with_slots(shards, slots, target)


def migrate_slot(placed: DataFrame, shards: DataFrame, at: int, source: int, target: int, next_seq: int) -> tuple[DataFrame, DataFrame]:
    """``migrate_slots`` of one slot; done again it changes no live pair."""
    return migrate_slots(placed, shards, [at], source, target, next_seq)

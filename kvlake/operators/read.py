"""Reads over the op log: newest live view, snapshots, scans and lookups.

Key bounds and ``seq <= S`` stay below the choice of the newest version, so they reach the Parquet
scan; tombstones are dropped above it, so they can't bring older versions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.model import PUT, RESERVED_PREFIX
from kvlake.plans.lineage import cut


def key_range(start: bytes | None, end: bytes | None, empty_end_is_open: bool = False) -> Column:
    """``start <= key < end``; None is open. An empty ``end`` holds nothing, or is open as in remote scans."""
    if end == b"" and empty_end_is_open:
        end = None
    bounds = F.lit(True)
    if start is not None:
        bounds = bounds & (F.col("key") >= F.lit(start))
    if end is not None:
        bounds = bounds & (F.col("key") < F.lit(end))
    return bounds


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def user_keys(ops: DataFrame) -> DataFrame:
    """Without the reserved key space."""
    return ops.where(~F.startswith("key", F.lit(RESERVED_PREFIX)))


def newest(ops: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest version of each key, tombstones included. Each task passes on one row a key: hot keys don't weigh."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return ops.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def latest_live(ops: DataFrame) -> DataFrame:
    """Newest version of each key that isn't deleted."""
    return newest(user_keys(ops)).where(F.col("kind") == PUT)


def as_of(ops: DataFrame, seq: int) -> DataFrame:
    """The live view at a sequence number."""
    return latest_live(ops.where(F.col("seq") <= seq))


def scan(ops: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, seq: int | None = None) -> DataFrame:
    """Live pairs of a key range in key order, the first ``limit`` of them."""
    held = ops.where(key_range(start, end))
    live = latest_live(held) if seq is None else as_of(held, seq)
    ordered = live.select("key", "value").orderBy("key")
    return ordered if limit is None else ordered.limit(limit)


def prefix_scan(ops: DataFrame, prefix: bytes, limit: int | None = None) -> DataFrame:
    return scan(ops, prefix, prefix_end(prefix), limit)


def scan_from(ops: DataFrame, start: bytes, n: int) -> DataFrame:
    """The first ``n`` live pairs from a key on."""
    return scan(ops, start, None, n)


def scan_after(ops: DataFrame, after: bytes, limit: int) -> DataFrame:
    """The next page: strictly after a key."""
    return scan(ops, after + b"\x00", None, limit)


def get(ops: DataFrame, key: bytes) -> DataFrame:
    """The live pair of one key, or no row."""
    return latest_live(ops.where(F.col("key") == F.lit(key))).select("key", "value")


def multi_get(ops: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, found, value) for each row of ``wanted`` (key), repeated rows included; absence is no error.

    Ops are cut to the wanted keys before versions are compared. Spark broadcasts the keys if they are few.
    """
    keys = wanted.select("key").distinct()
    live = latest_live(ops.join(keys, "key", "left_semi")).select("key", "value")
    return wanted.select("key").join(live, "key", "left").select("key", F.col("value").isNotNull().alias("found"), "value")


def versions(ops: DataFrame) -> DataFrame:
    """Every version with the sequence number that ends it (null: still current)."""
    w = Window.partitionBy("key").orderBy("seq")
    return user_keys(ops).withColumn("next_seq", F.lead("seq").over(w))


def tombstones(ops: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(user_keys(ops)).where(F.col("kind") != PUT).select("key", "seq")


def asof_join(probes: DataFrame, ops: DataFrame) -> DataFrame:
    """For each probe (probe_id, key, at_seq) the version visible then: probe_id, key, at_seq, seq, kind, value.

    Probes and versions are put in one order by (key, seq) and the last version is carried forward:
    one shuffle, and no pairs of probes and versions.
    """
    a = probes.select("key", F.col("at_seq").alias("at"), F.lit(1).alias("side"), "probe_id", F.lit(None).cast("struct<seq:bigint,kind:tinyint,value:binary>").alias("version"))
    b = ops.join(probes.select("key").distinct(), "key", "left_semi").select(
        "key", F.col("seq").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.struct("seq", F.col("kind").cast("tinyint").alias("kind"), "value").alias("version")
    )
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("version", F.last("version", ignorenulls=True).over(w))
    return met.where("side = 1").select("probe_id", "key", F.col("at").alias("at_seq"), "version.seq", "version.kind", "version.value")


#: Neighbouring keys that a scan of many reads together.
SCAN_BLOCK = 128


def multi_scan(ops: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first n live pairs from a key on for each scan (scan_id, start, n): scan_id, place (from 1), key, value.

    Live keys and starts are dealt in one order and numbered; a scan is then a run of numbers and meets
    the keys by blocks of them: an equi-join, whatever the scans.
    """
    live = latest_live(ops).select("key", "value")
    starts = wanted.select("scan_id", F.col("start").alias("key"), F.col("n").cast("long").alias("n"))
    both = live.withColumn("held", F.lit(1)).unionByName(starts.withColumn("held", F.lit(0)), allowMissingColumns=True)
    dealt = cut(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col("_part").alias("_of")).agg(F.sum("held").alias("_n"))
    counts = counts.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("held").over(Window.partitionBy("_part").orderBy("key", "held").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = dealt.withColumn("_within", within).join(counts, F.col("_part") == F.col("_of")).withColumn("at", F.col("_before") + F.col("_within"))
    keys = at.where("held = 1").select(F.expr(f"at div {SCAN_BLOCK}").alias("block"), F.col("at").alias("key_at"), "key", "value")
    blocks = F.expr(f"sequence(at div {SCAN_BLOCK}, (at + n - 1) div {SCAN_BLOCK})")
    scans = at.where("held = 0 and n > 0").select("scan_id", F.col("at").alias("first"), "n", F.explode(blocks).alias("block"))
    met = scans.join(keys, "block").where("key_at >= first and key_at < first + n")
    return met.select("scan_id", (F.col("key_at") - F.col("first") + 1).alias("place"), "key", "value")

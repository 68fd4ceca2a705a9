"""Levels, manifest and compaction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.model import LEVELS, PUT
from kvlake.plans.lineage import cut

from .read import newest

#: Fixed values of the level policy.
L0_TRIGGER, L0_STOP, BASE_BYTES, GROWTH, FILE_BYTES = 4, 12, 10 << 20, 10, 2 << 20


def level_scores(files: DataFrame) -> DataFrame:
    """level, n_files, bytes and score of every level but the last; a score of 1 or more calls for compaction."""
    totals = files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    most = F.lit(float(BASE_BYTES)) * F.pow(F.lit(float(GROWTH)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(L0_TRIGGER))).otherwise(F.col("bytes") / most)
    return totals.where(F.col("level") < LEVELS - 1).withColumn("score", score)


def pick_level(scores: DataFrame) -> DataFrame:
    """The level to compact: the highest score of 1 or more, of equals the deeper; no row if none calls."""
    return scores.where("score >= 1").orderBy(F.desc("score"), F.desc("level")).limit(1)


def must_stall(files: DataFrame) -> DataFrame:
    """Whether writes must wait for level 0 (one row)."""
    return files.agg((F.count_if(F.col("level") == 0) >= L0_STOP).alias("stalled"))


def rotation_pick(files: DataFrame, level: int, after: bytes | None) -> DataFrame:
    """The level's next file after the last one compacted, or its first again."""
    passed = F.lit(False) if after is None else F.col("smallest") <= F.lit(after)
    return files.where(F.col("level") == level).orderBy(passed, "smallest").limit(1)


def key_bounds(files: DataFrame, *by: str) -> DataFrame:
    """The key range of files, of all or of each group."""
    return files.groupBy(*by).agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def overlapping(files: DataFrame, others: DataFrame) -> DataFrame:
    """(file_num, other_num) of files whose key ranges meet.

    A file list is metadata: a row for each stored file, so one side is a level and Spark broadcasts
    it if it is small enough.
    """
    o = others.select(F.col("file_num").alias("other_num"), F.col("smallest").alias("_low"), F.col("largest").alias("_high"))
    return files.join(o, (F.col("smallest") <= F.col("_high")) & (F.col("largest") >= F.col("_low"))).select("file_num", "other_num")


def pick_compaction(files: DataFrame, pointers: Mapping[int, bytes] | None = None) -> DataFrame:
    """What to compact next: role (input or next), level, file_num; no row if no level calls.

    The level by score; all of level 0, or the file after the level's pointer (the smallest key of its
    last pick); and the files of the next level that the inputs' key range meets. The level is one number
    on the driver, the rest stays in the plan.
    """
    picked = pick_level(level_scores(files)).select("level").first()
    level = -1 if picked is None else picked.level
    inputs = files.where(F.col("level") == 0) if level == 0 else rotation_pick(files, level, (pointers or {}).get(level))
    span = key_bounds(inputs).select(F.lit("inputs").alias("file_num"), "smallest", "largest")
    below = files.where(F.col("level") == level + 1)
    met = below.join(overlapping(span, below).select(F.col("other_num").alias("file_num")).distinct(), "file_num", "left_semi") if level >= 0 else below.where("false")
    return inputs.select(F.lit("input").alias("role"), "level", "file_num").unionByName(met.select(F.lit("next").alias("role"), "level", "file_num"))


def held_below(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key lies in one of ``ranges`` (smallest, largest).

    In key order a key is held if the largest end among the ranges that began before it reaches it.
    Rows are range-partitioned; partitions' own largest ends are carried on in a second step, a row
    for each partition. Neither keys nor ranges are gathered in one task or broadcast.
    """
    columns = keys.columns
    begins = ranges.select(F.col("smallest").alias("key"), F.lit(0).alias("_side"), F.col("largest").alias("_end"))
    both = keys.withColumn("_side", F.lit(1)).unionByName(begins, allowMissingColumns=True)
    dealt = cut(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy("_part").agg(F.max("_end").alias("_most"))
    carried = ends.select(F.col("_part").alias("_of"), F.max("_most").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_part").orderBy("key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("_reach", F.max("_end").over(w)).join(carried, F.col("_part") == F.col("_of"))
    return met.where("_side = 1 and (key <= _reach or key <= _before)").select(columns)


def merge(ops: DataFrame, deeper: DataFrame | None) -> DataFrame:
    """Newest version of each key; a tombstone goes if no deeper file's key range holds its key."""
    kept = newest(ops)
    live = kept.where(F.col("kind") == PUT)
    return live if deeper is None else live.unionByName(held_below(kept.where(F.col("kind") != PUT), deeper))


def split_outputs(merged: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Add ``part`` and ``file_no``: disjoint sorted outputs, each closed by the row that fills it; parts are ranges of keys."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 8
    dealt = cut(merged.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("file_no", F.floor(before / file_bytes).cast("long"))


def level_faults(files: DataFrame) -> DataFrame:
    """Files below level 0 that begin before their predecessor's end: level, file_num, previous_num."""
    w = Window.partitionBy("level").orderBy("smallest", "file_num")
    seen = files.where("level > 0").withColumn("_end", F.lag("largest").over(w)).withColumn("previous_num", F.lag("file_num").over(w))
    return seen.where("smallest <= _end").select("level", "file_num", "previous_num")


def live_files(edits: DataFrame) -> DataFrame:
    """The files of the current version: of each file the last edit counts."""
    w = Window.partitionBy("level", "file_num").orderBy(F.desc("edit_id"))
    last = edits.withColumn("_nth", F.row_number().over(w)).where("_nth = 1 and action = 'add'")
    return last.select("level", "file_num", "size", "smallest", "largest")


def edit_faults(edits: DataFrame) -> DataFrame:
    """Edits that add a file that is there or delete one that isn't: edit_id, level, file_num, fault."""
    w = Window.partitionBy("level", "file_num").orderBy("edit_id")
    seen = edits.withColumn("_was", F.coalesce(F.lag("action").over(w), F.lit("delete")))
    fault = F.when((F.col("action") == "add") & (F.col("_was") == "add"), F.lit("already_there")).when((F.col("action") == "delete") & (F.col("_was") == "delete"), F.lit("not_there"))
    return seen.withColumn("fault", fault).where("fault is not null").select("edit_id", "level", "file_num", "fault")


def obsolete_files(listing: DataFrame, live: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Stored files that neither the version nor a pending job needs."""
    gone = listing.select("file_num").join(live.select("file_num"), "file_num", "left_anti")
    return gone if protected is None else gone.join(protected.select("file_num"), "file_num", "left_anti")


def maintenance_metrics(maintenance: DataFrame, user_bytes: int | None = None) -> DataFrame:
    """Counters of a maintenance log (kind flush or compaction, bytes): one row, with write amplification if the user's bytes are known."""
    flush, compaction = F.col("kind") == "flush", F.col("kind") == "compaction"
    out = maintenance.agg(
        F.count_if(flush).alias("flushes"),
        F.coalesce(F.sum(F.when(flush, F.col("bytes"))), F.lit(0)).alias("flushed_bytes"),
        F.count_if(compaction).alias("compactions"),
        F.coalesce(F.sum(F.when(compaction, F.col("bytes"))), F.lit(0)).alias("compacted_bytes"),
    )
    return out if user_bytes is None else out.withColumn("write_amplification", (F.col("flushed_bytes") + F.col("compacted_bytes")) / user_bytes)

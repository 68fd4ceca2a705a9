"""Running a batch of client requests against a stored log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.model import PUT

from .read import asof_join, multi_scan


def writes_of(requests: DataFrame, last_seq: int) -> DataFrame:
    """The puts that requests (i from 0, op, key, value) make, numbered after ``last_seq`` in the order of i."""
    return requests.where(F.col("op").isin("update", "insert", "rmw")).select((F.col("i") + (last_seq + 1)).alias("seq"), "key", F.lit(PUT).cast("tinyint").alias("kind"), "value")


def reads_of(ops: DataFrame, requests: DataFrame, last_seq: int) -> DataFrame:
    """What each read (op read or rmw) returns: i, found, value. It sees the log and the batch's writes before it."""
    probes = requests.where(F.col("op").isin("read", "rmw")).select(F.col("i").alias("probe_id"), "key", (F.col("i") + last_seq).alias("at_seq"))
    met = asof_join(probes, ops.select("seq", "key", "kind", "value").unionByName(writes_of(requests, last_seq)))
    found = F.coalesce(F.col("kind") == PUT, F.lit(False))
    return met.select(F.col("probe_id").alias("i"), found.alias("found"), F.when(found, F.col("value")).alias("value"))


def scans_of(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """What each scan (key and n_scan) returns, from the log as it was before the batch: i, pairs, value_bytes."""
    wanted = requests.where("op = 'scan'").select(F.col("i").alias("scan_id"), F.col("key").alias("start"), F.col("n_scan").alias("n"))
    met = multi_scan(ops, wanted).groupBy(F.col("scan_id").alias("i")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.octet_length("value")).cast("long").alias("value_bytes"))
    zero = F.lit(0).cast("long")
    return wanted.select(F.col("scan_id").alias("i")).join(met, "i", "left").select("i", F.coalesce("pairs", zero).alias("pairs"), F.coalesce("value_bytes", zero).alias("value_bytes"))

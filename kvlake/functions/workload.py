"""Benchmark workloads as DataFrames: db_bench style fills and reads, and YCSB A to F."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators.log import running_total

from .hashing import user_key

#: Percent of each op by workload, and how keys are drawn.
MIXES = {
    "a": ({"update": 50, "read": 50}, "zipfian"),
    "b": ({"update": 5, "read": 95}, "zipfian"),
    "c": ({"read": 100}, "zipfian"),
    "d": ({"read": 95, "insert": 5}, "latest"),
    "e": ({"scan": 95, "insert": 5}, "zipfian"),
    "f": ({"rmw": 50, "read": 50}, "zipfian"),
}
THETA = 0.99
MAX_SCAN = 100


def op_for(workload: str, draw: Column) -> Column:
    """The op of a draw from 0 to 99."""
    upto, out = 0, F
    for name, share in MIXES[workload][0].items():
        upto += share
        out = out.when(draw < upto, F.lit(name))
    return out


def mixed(rows: DataFrame, draw: Column) -> DataFrame:
    """Each row once for each workload, with its op."""
    ops = F.array(*[F.struct(F.lit(w).alias("workload"), op_for(w, draw).alias("op")) for w in MIXES])
    return rows.select("*", F.explode(ops).alias("_one")).select("*", "_one.workload", "_one.op").drop("_one")


def zeta(n: int, theta: float = THETA) -> float:
    """Sum of 1 / i**theta: exact up to a million terms, with an integral for what is beyond."""
    near = min(n, 1_000_000)
    total = math.fsum(1.0 / i**theta for i in range(1, near + 1))
    if n > near:
        total += ((n + 0.5) ** (1 - theta) - (near + 0.5) ** (1 - theta)) / (1 - theta)
    return total


def zipfian(u: Column, n: int, theta: float = THETA) -> Column:
    """A number from 0 to n - 1 from a uniform draw, small ones the likelier."""
    zn, z2 = zeta(n, theta), zeta(2, theta)
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - z2 / zn)
    far = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(1.0 / (1 - theta))))
    drawn = F.when(u * zn < 1.0, F.lit(0)).when(u * zn < 1.0 + 0.5**theta, F.lit(1)).otherwise(far)
    return F.least(drawn.cast("long"), F.lit(n - 1).cast("long"))


def record_value(i: Column, size: int) -> Column:
    """``size`` letters, a to z in turn."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.lit((letters * (size // 26 + 1))[:size]).cast("binary")


def load(spark: SparkSession, records: int, value_size: int = 100) -> DataFrame:
    """The ops that load a keyspace."""
    return spark.range(1, records + 1).select(
        F.col("id").alias("seq"), user_key(F.col("id") - 1).cast("binary").alias("key"), F.lit(1).cast("tinyint").alias("kind"), record_value(F.col("id"), value_size).alias("value")
    )


def fill(spark: SparkSession, n: int, value_size: int = 100, shuffled: bool = False, seed: int = 1) -> DataFrame:
    """The ops of a sequential or random fill; keys are ``key-`` and twelve digits."""
    number = F.floor(F.rand(seed) * n).cast("long") if shuffled else F.col("id") - 1
    return spark.range(1, n + 1).select(F.col("id").alias("seq"), F.format_string("key-%012d", number).cast("binary").alias("key"), F.lit(1).cast("tinyint").alias("kind"), record_value(F.col("id"), value_size).alias("value"))


def uniform(u: Column, n: int) -> Column:
    """A number from 0 to n - 1 from a uniform draw, all alike."""
    return F.least(F.floor(u * n).cast("long"), F.lit(n - 1).cast("long"))


def latest(u: Column, hi: Column, n: int, theta: float = THETA) -> Column:
    """A number below ``hi``, the newest the likelier: ``n`` numbers back at most."""
    return hi - 1 - zipfian(u, n, theta) % hi


def requests(spark: SparkSession, workload: str, n: int, records: int, seed: int = 7, value_size: int = 100) -> DataFrame:
    """The requests of a YCSB run: i, op, key, n_scan, value. Inserts take the next record each, and the newest are those before a request."""
    rows = spark.range(n).select(F.col("id").alias("i"), F.floor(F.rand(seed) * 100).alias("draw"), F.rand(seed + 1).alias("u"), (F.floor(F.rand(seed + 2) * MAX_SCAN) + 1).cast("int").alias("n_scan"))
    rows = rows.withColumn("op", op_for(workload, F.col("draw")))
    shares, picker = MIXES[workload]
    hi = F.lit(records).cast("long")
    if "insert" in shares:
        rows = running_total(rows.withColumn("_new", (F.col("op") == "insert").cast("long")), "i", "_new", "_taken")
        hi = hi + F.col("_taken")
    at = latest(F.col("u"), hi, records) if picker == "latest" else zipfian(F.col("u"), records)
    at = F.when(F.col("op") == "insert", hi).otherwise(at)
    return rows.select("i", "op", user_key(at).cast("binary").alias("key"), "n_scan", record_value(F.col("i"), value_size).alias("value"))

"""Exact order statistics of latency reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES: Mapping[str, float] = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p100": 1.0}
#: Upper bounds of request-duration buckets, in seconds.
DURATION_BOUNDS = tuple(1e-5 * 4**i for i in range(10))


def latency_report(latencies: DataFrame, by: list[str], value: str = "nanos", quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """Count and exact quantiles of each group: the value at place ``floor(p * (n - 1))`` in order, from 0.

    Values are counted first, so a group costs a row for each distinct value, not for each
    measurement, and no group's values are gathered in one array.
    """
    counts = latencies.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*by)
    upto = F.sum("c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("ops", F.sum("c").over(group))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("ops") - 1)), F.col(value))).alias(name) for name, p in quantiles.items()]
    return ranked.groupBy(*by).agg(F.max("ops").alias("ops"), *picks)


def duration_bucket(seconds: Column) -> Column:
    """Number of the duration bucket, from 0; 10 beyond the last bound."""
    out = F.lit(len(DURATION_BOUNDS))
    for i in range(len(DURATION_BOUNDS) - 1, -1, -1):
        out = F.when(seconds <= DURATION_BOUNDS[i], F.lit(i)).otherwise(out)
    return out


def throughput(latencies: DataFrame, by: list[str], elapsed_seconds: Column) -> DataFrame:
    """Ops and ops a second of each group."""
    return latencies.groupBy(*by).agg(F.count(F.lit(1)).alias("ops")).withColumn("ops_per_sec", F.col("ops") / elapsed_seconds)


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests of each method and result code: method, code, n."""
    return requests.groupBy("method", "code").agg(F.count(F.lit(1)).alias("n"))

"""Audits of histories and committed logs, statistics and workloads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions import stats, workload
from kvlake.model import HISTORY
from kvlake.operators import audit


def test_divergence(spark):
    a = spark.createDataFrame([(b"x", b"1"), (b"y", b"2"), (b"e", b"")], "key binary, value binary")
    b = spark.createDataFrame([(b"x", b"1"), (b"y", b"3"), (b"z", b"4")], "key binary, value binary")
    assert sorted(bytes(r.key) for r in audit.divergence(a, b).collect()) == [b"e", b"y", b"z"]
    assert audit.divergence(a, a).collect() == []


def test_histories(spark):
    rows = [
        (1, "put", b"a", b"v", 0, 10, True),
        (2, "get", b"a", b"v", 11, 12, True),
        (3, "get", b"a", None, 11, 13, True),
        (4, "get", b"a", None, 9, 13, True),
        (5, "put", b"b", b"w", 0, 10, False),
        (6, "get", b"b", None, 20, 21, True),
        (7, "get", b"a", b"other", 30, 31, True),
        (8, "put", b"c", b"u", 0, 5, True),
    ]
    h = spark.createDataFrame(rows, HISTORY)
    assert sorted(r.op_id for r in audit.stale_reads(h).collect()) == [3, 7]
    state = spark.createDataFrame([(b"a", b"v")], "key binary, value binary")
    assert [bytes(r.key) for r in audit.lost_acks(h, state).collect()] == [b"c"]


def test_consensus_audits(spark):
    terms = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 3)], "term long, leader long")
    assert [tuple(r) for r in audit.split_terms(terms).collect()] == [(2, 2)]
    entries = spark.createDataFrame([(n, i, 1, b"x" if (n, i) != (2, 3) else b"y") for n in range(3) for i in range(5)], "node long, log_index long, term long, data binary")
    assert [tuple(r) for r in audit.log_conflicts(entries).collect()] == [(3, 2)]
    changes = spark.createDataFrame([(1, 1, "add"), (2, 2, "add_learner"), (3, 3, "add"), (4, 1, "remove"), (5, 2, "add")], "log_index long, node long, action string")
    assert sorted(map(tuple, audit.membership(changes).collect())) == [(2, "voter"), (3, "voter")]
    matches = spark.createDataFrame([("g", 5), ("g", 9), ("g", 7), ("h", 1), ("h", 2)], "g string, match_index long")
    assert {r.g: r.commit_index for r in audit.quorum_index(matches, ["g"]).collect()} == {"g": 7, "h": 1}
    matches = spark.createDataFrame([(g, i) for g in (1, 2, 3, 4) for i in (9, 7, 5)], "group_id long, match_index long")
    logs = spark.createDataFrame([(1, 7, 3), (2, 7, 2), (3, 7, 3)], "group_id long, log_index long, term long")
    leaders = spark.createDataFrame([(1, 3, 4), (2, 3, 4), (3, 3, 8), (4, 3, 1)], "group_id long, term long, committed long")
    # Of the own term; of an older one; behind what is committed; not in the log.
    assert {r.group_id: r.commit_index for r in audit.commit_index(matches, logs, leaders).collect()} == {1: 7, 2: 4, 3: 8, 4: 1}
    votes = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 1, 3)], "node long, term long, candidate long")
    assert [tuple(r) for r in audit.double_votes(votes).collect()] == [(2, 1, 2)]
    proposed = spark.createDataFrame([(1, 5, 4), (1, 9, 5), (1, 12, 8), (2, 10, 9)], "group_id long, log_index long, applied long")
    assert [tuple(r) for r in audit.overlapping_changes(proposed).collect()] == [(1, 12, 9)]
    assert tuple(audit.reached_epoch(spark.createDataFrame([(1,), (3,), (4,)], "epoch long"), 3).first()) == (2, 3)


@pytest.mark.parametrize("n", [1, 2, 10, 137])
def test_percentiles_are_order_statistics(spark, n):
    r = random.Random(n)
    values = [r.randrange(50) for _ in range(n)]
    df = spark.createDataFrame([("read", v) for v in values] + [("read", None)], "op string, nanos long")
    got = stats.latency_report(df, ["op"]).first().asDict()
    ordered = sorted(values)
    assert got == {"op": "read", "ops": n} | {name: ordered[int(p * (n - 1))] for name, p in stats.QUANTILES.items()}


def test_duration_buckets(spark):
    seconds = [0.0, 1e-5, 1.1e-5, 1.0, 2.62144, 3.0]
    got = spark.createDataFrame([(s,) for s in seconds], "s double").select(stats.duration_bucket(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 9, 9, 10]
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "op string")
    assert {r.op: r.ops_per_sec for r in stats.throughput(rows, ["op"], F.lit(2.0)).collect()} == {"a": 1.0, "b": 0.5}


def test_workload_shapes(spark):
    n = 20_000
    for name, (shares, _) in workload.MIXES.items():
        got = {r.op: r["count"] for r in workload.requests(spark, name, n, 1000).groupBy("op").count().collect()}
        assert set(got) == set(shares)
        assert all(abs(got[op] / n - share / 100) < 0.02 for op, share in shares.items())


def test_zipfian_skew(spark):
    draws = spark.range(200_000).select(workload.zipfian(F.rand(3), 10_000).alias("k"))
    assert draws.where("k < 0 or k >= 10000").count() == 0
    assert draws.where("k < 100").count() >= 100_000


def test_fills(spark):
    keys = [bytes(r.key) for r in workload.fill(spark, 5).collect()]
    assert keys == [b"key-%012d" % i for i in range(5)]
    assert bytes(workload.load(spark, 3, 30).first().value) == b"abcdefghijklmnopqrstuvwxyzabcd"
    assert workload.load(spark, 500).select("key").distinct().count() == 500

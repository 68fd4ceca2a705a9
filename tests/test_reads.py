"""Reads over the op log against the plain model."""

from __future__ import annotations

import random

import pytest

from kvlake.model import OPS
from kvlake.operators import read

from .model import live, random_ops

GOLDEN = [
    (9, b"user:0001", 1, b"alice"),
    (4, b"user:0001", 1, b"al"),
    (7, b"user:0002", 0, None),
    (3, b"user:0002", 1, b"bob"),
    (2, b"user:0002", 1, b"b2"),
    (12, b"user:0010", 1, b"carol-with-a-longer-value"),
    (13, b"user:0011", 1, b"dan"),
    (2, b"user:0020", 1, b""),
    (1, b"zzz", 1, b"end"),
]


def pairs(df) -> dict[bytes, bytes]:
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, OPS).cache()


@pytest.fixture(scope="module")
def log():
    return random_ops(3000, 120, 11)


@pytest.fixture(scope="module")
def ops(spark, log):
    return spark.createDataFrame(log, OPS).repartition(5).cache()


def test_golden_table(golden):
    assert pairs(read.latest_live(golden)) == {b"user:0001": b"alice", b"user:0010": b"carol-with-a-longer-value", b"user:0011": b"dan", b"user:0020": b"", b"zzz": b"end"}
    assert pairs(read.as_of(golden, 4)) == {b"user:0001": b"al", b"user:0002": b"bob", b"user:0020": b"", b"zzz": b"end"}


def test_live_views_at_many_points(ops, log):
    assert pairs(read.latest_live(ops)) == live(log)
    for seq in (0, 1, 17, 500, 1499, 2999):
        assert pairs(read.as_of(ops, seq)) == live(log, seq)


@pytest.mark.parametrize(("start", "end"), [(b"key-0010", b"key-0050"), (b"key-0060", b"key-0060"), (b"key-0080", b"key-0010"), (b"zzz", None), (None, b""), (None, None), (b"", b"key-0003")])
def test_ranges(ops, log, start, end):
    want = {k: v for k, v in live(log).items() if (start is None or k >= start) and (end is None or k < end)}
    got = [(bytes(r.key), bytes(r.value)) for r in read.scan(ops, start, end).collect()]
    assert got == sorted(want.items())
    assert [bytes(r.key) for r in read.scan(ops, start, end, 7).collect()] == sorted(want)[:7]


def test_remote_scans_take_an_empty_end_for_open(ops, log):
    assert ops.where(read.key_range(None, b"", empty_end_is_open=True)).count() == len(log)


def test_prefixes():
    assert read.prefix_end(b"ab") == b"ac"
    assert read.prefix_end(b"a\xff\xff") == b"b"
    assert read.prefix_end(b"\xff") is None


def test_prefix_scan_and_pages(ops, log):
    view = live(log)
    assert pairs(read.prefix_scan(ops, b"key-01")) == {k: v for k, v in view.items() if k.startswith(b"key-01")}
    after, seen = b"", []
    while page := read.scan_after(ops, after, 13).collect():
        seen += [bytes(r.key) for r in page]
        after = seen[-1]
    assert seen == sorted(view)
    assert [bytes(r.key) for r in read.scan_from(ops, b"key-0050", 3).collect()] == [k for k in sorted(view) if k >= b"key-0050"][:3]


def test_lookups(spark, ops, log):
    view = live(log)
    wanted = [b"key-0001", b"key-0002", b"nope", b"key-0001"]
    got = read.multi_get(ops, spark.createDataFrame([(k,) for k in wanted], "key binary")).collect()
    assert sorted((bytes(r.key), r.found, r.value and bytes(r.value)) for r in got) == sorted((k, k in view, view.get(k)) for k in wanted)
    for k in wanted:
        assert pairs(read.get(ops, k)) == ({k: view[k]} if k in view else {})
    dead = {k for _, k, _, _ in log} - set(view)
    assert {bytes(r.key) for r in read.tombstones(ops).collect()} == dead


def test_versions_and_asof(spark, ops, log):
    chain = {}
    for seq, key, _, _ in log:
        chain.setdefault(key, []).append(seq)
    want = {(k, s): n for k, seqs in chain.items() for s, n in zip(seqs, [*seqs[1:], None], strict=True)}
    assert {(bytes(r.key), r.seq): r.next_seq for r in read.versions(ops).collect()} == want
    probes = [(i, b"key-%04d" % (i % 130), i * 7 % 3001) for i in range(400)]
    got = {r.probe_id: r.seq for r in read.asof_join(spark.createDataFrame(probes, "probe_id long, key binary, at_seq long"), ops).collect()}
    assert got == {i: max((s for s in chain.get(k, []) if s <= at), default=None) for i, k, at in probes}


def test_reserved_keys_are_hidden(spark):
    df = spark.createDataFrame([(1, b"\x00!raft/applied", 1, b"x"), (2, b"a", 1, b"y")], OPS)
    assert pairs(read.latest_live(df)) == {b"a": b"y"}


def test_bounds_reach_the_scan(spark, ops, tmp_path):
    ops.write.parquet(str(tmp_path / "ops"))
    plan = read.scan(spark.read.schema(OPS).parquet(str(tmp_path / "ops")), b"key-0010", b"key-0050", 5, seq=100)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "IsNotNull(seq)" in pushed
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_many_scans_at_once(spark):
    ops = random_ops(2000, 400, 17)
    view = sorted(live(ops).items())
    r = random.Random(5)
    wanted = [(i, b"key-%04d" % r.randrange(-20, 450), r.choice((0, 1, 3, 40, 300, 10_000))) for i in range(60)] + [(99, b"", 5), (100, b"zzz", 5)]
    df = spark.createDataFrame(ops, OPS).repartition(5)
    got: dict[int, list] = {}
    for x in read.multi_scan(df, spark.createDataFrame(wanted, "scan_id long, start binary, n long")).collect():
        got.setdefault(x.scan_id, []).append((x.place, bytes(x.key), bytes(x.value)))
    for i, start, n in wanted:
        want = [(k, v) for k, v in view if k >= start][:n]
        assert sorted(got.get(i, [])) == [(place, k, v) for place, (k, v) in enumerate(want, 1)]

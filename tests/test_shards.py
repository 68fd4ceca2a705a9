"""Slots, maps, routing and migration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvlake.functions import hashing
from kvlake.model import OPS
from kvlake.operators import read, shard

from .model import live, random_ops

PLACED = "group_id long, seq long, key binary, kind tinyint, value binary"


def owners(df) -> dict[int, tuple]:
    return {r.slot: (r.epoch, r.group_id, r.migrating) for r in df.collect()}


def test_crc32c_and_slots(spark):
    known = {b"": 0, b"key-1": 209, b"123456789": 131, b"hello": 76, b"user:1001": 235}
    keys = [*known, b"\x00\xff\x00", bytes(range(256))]
    df = spark.createDataFrame([(k,) for k in keys], "key binary").select("key", hashing.crc32c(F.col("key")).alias("crc"), hashing.slot(F.col("key")).alias("slot"))
    got = {bytes(r.key): r for r in df.collect()}
    assert {k: got[k].slot for k in known} == known
    assert got[b"123456789"].crc == 0xE3069283
    assert all(got[k].slot == hashing.literal_slot(k) for k in keys)


def test_user_keys_hash_unsigned(spark):
    def fnv(i: int) -> int:
        h = hashing.FNV_OFFSET
        for b in i.to_bytes(8, "little"):
            h = (h ^ b) * hashing.FNV_PRIME % 2**64
        return h

    numbers = [0, 1, 255, 256, 10**12, 2**62]
    got = spark.createDataFrame([(i,) for i in numbers], "i long").select("i", hashing.user_key(F.col("i")).alias("key")).collect()
    assert {r.i: r.key for r in got} == {i: f"user{fnv(i)}" for i in numbers}


def test_maps(spark):
    m = shard.initial_map(spark, [30, 10, 40, 20])
    assert {g: len(s) for g, s in ((r.group_id, r.slots) for r in shard.slots_of(m).collect())} == dict.fromkeys((10, 20, 30, 40), 64)
    assert owners(m)[1] == (1, 20, False)
    assert set(owners(shard.initial_map(spark, [])).values()) == {(1, 0, False)}
    assert owners(shard.with_slot(shard.with_migrating(m, 7), 7, 99))[7] == (3, 99, False)
    gone = owners(shard.with_reassign(shard.with_migrating(m, 0), 10, 20))
    assert gone[0] == (3, 20, True) and all(g != 10 for _, g, _ in gone.values())
    assert sorted(r.group_id for r in shard.groups_of(m).collect()) == [10, 20, 30, 40]
    newer = shard.with_slot(m, 5, 10)
    assert owners(shard.adopt(m.unionByName(newer))) == owners(newer)


def test_scatter_gather_and_stray_copies(spark):
    ops = random_ops(1500, 240, 5)
    m = shard.initial_map(spark, [10, 20, 30])
    homes = {r.slot: r.group_id for r in m.collect()}
    placed = [(homes[hashing.literal_slot(o[1])], *o) for o in ops]
    stray = [(10, s + 10_000, k, 1, b"stray") for g, s, k, _, _ in placed[:200] if g != 10]
    df = spark.createDataFrame(placed + stray, PLACED)
    want = {k: v for k, v in live(ops).items() if b"key-0050" <= k < b"key-0150"}
    got = [(bytes(r.key), bytes(r.value)) for r in shard.cluster_scan(df, m, b"key-0050", b"key-0150", 30).collect()]
    assert got == sorted(want.items())[:30]
    assert any(bytes(r.value) == b"stray" for r in shard.group_scan(df, 10).collect())


def test_writes_are_classified(spark):
    m = shard.with_migrating(shard.with_reassign(shard.initial_map(spark, [10, 20]), 20, 0), 76)
    rows = [(b"", 10), (b"hello", 10), (b"key-1", 10), (b"user:1001", 10), (b"w", 10), (b"w", 20)]
    got = [(bytes(r.key), r.routed_group, r.verdict) for r in shard.classify_writes(spark.createDataFrame(rows, "key binary, routed_group long"), m).collect()]
    verdicts = {(k, g): v for k, g, v in got}
    assert verdicts[b"", 10] == "empty_key" and verdicts[b"hello", 10] == "migrating" and verdicts[b"key-1", 10] == "unassigned"
    assert hashing.literal_slot(b"w") % 2 or verdicts[b"w", 20] == "wrong_group"


def test_migration_keeps_the_view_and_resumes(spark):
    ops = random_ops(4000, 600, 6)
    m = shard.initial_map(spark, [10, 20])
    at = hashing.literal_slot(b"key-0007")
    source = 10 if at % 2 == 0 else 20
    target = 30 - source
    homes = {r.slot: r.group_id for r in m.collect()}
    df = spark.createDataFrame([(homes[hashing.literal_slot(o[1])], *o) for o in ops], PLACED)
    view = live(ops)
    mine = sorted(k for k in view if hashing.literal_slot(k) == at)
    copied = sorted(bytes(r.key) for r in shard.copy_slot(df, at, source, target).collect())
    assert copied == mine
    middle = mine[len(mine) // 2] if mine else b""
    rest = shard.copy_slot(df, at, source, target, after=middle)
    assert sorted(bytes(r.key) for r in rest.collect()) == [k for k in mine if k > middle]
    cursor = shard.copy_cursor(rest).first()
    assert cursor.copied == len([k for k in mine if k > middle])
    assert shard.copy_slot(df, at, source, target, after=b"\xff").count() == 0
    for _ in range(2):  # the second time changes nothing
        df, m = shard.migrate_slot(df, m, at, source, target, 100_000)
        df = df.cache()
        assert {bytes(r.key): bytes(r.value) for r in shard.cluster_scan(df, m).collect()} == view
        assert owners(m)[at][1:] == (target, False)
    left = [r for r in shard.group_scan(df, source).collect() if hashing.literal_slot(bytes(r.key)) == at]
    assert left == []


def test_there_and_back(spark):
    """A slot that moves away and back keeps its pairs, though tombstones and strays lie in both groups."""
    ops = random_ops(3000, 500, 9)
    m = shard.initial_map(spark, [10, 20])
    homes = {r.slot: r.group_id for r in m.collect()}
    placed = [(homes[hashing.literal_slot(o[1])], *o) for o in ops]
    slots = list(range(0, 64, 2))
    keys = sorted({o[1] for o in ops if hashing.literal_slot(o[1]) in slots})
    assert len(keys) > 20
    strays = [(20, 50_000 + i, k, 1, b"stray") for i, k in enumerate(keys)]  # newer than the pairs themselves, deleted ones among them
    assert any(k not in live(ops) for k in keys)
    df, view, seq = spark.createDataFrame(placed + strays, PLACED), live(ops), 100_000
    for source, target in ((10, 20), (20, 10), (10, 20), (20, 10)):
        df, m = shard.migrate_slots(df, m, slots, source, target, seq)
        df, seq = df.cache(), seq + 10_000
        assert {bytes(r.key): bytes(r.value) for r in shard.cluster_scan(df, m).collect()} == view
        assert all(owners(m)[s][1:] == (target, False) for s in slots)
        assert [k for r in shard.group_scan(df, source).collect() if hashing.literal_slot(k := bytes(r.key)) in slots] == []
    assert df.groupBy("seq", "group_id").count().where("count > 1").count() == 0


def test_a_move_that_flipped_is_only_cleared(spark):
    m = shard.with_slot(shard.initial_map(spark, [10, 20]), 76, 20)
    assert hashing.literal_slot(b"hello") == 76
    df = spark.createDataFrame([(10, 1, b"hello", 1, b"old"), (20, 2, b"hello", 1, b"old"), (20, 3, b"hello", 1, b"written since")], PLACED)
    after, then = shard.migrate_slot(df, m, 76, 10, 20, 100)
    assert [bytes(r.value) for r in shard.cluster_scan(after, then).collect()] == [b"written since"]
    assert shard.group_scan(after, 10).count() == 0
    for source, target in ((30, 10), (10, 10)):
        with pytest.raises(ValueError, match="group"):
            shard.migrate_slot(df, m, 76, source, target, 100)


def test_copied_but_not_flipped_shows_no_pair_twice(spark):
    ops = random_ops(500, 60, 8)
    m = shard.initial_map(spark, [10, 20])
    homes = {r.slot: r.group_id for r in m.collect()}
    placed = [(homes[hashing.literal_slot(o[1])], *o) for o in ops]
    df = spark.createDataFrame(placed + [(30 - g, *o) for g, *o in placed], PLACED)
    got = [bytes(r.key) for r in shard.cluster_scan(df, m).collect()]
    assert got == sorted(live(ops))
    assert read.latest_live(spark.createDataFrame(ops, OPS)).count() == len(got)

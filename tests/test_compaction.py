"""Levels, manifest and compaction."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kvlake.model import EDITS, FILES, OPS
from kvlake.operators import compact, read

from .model import live, random_ops


def test_compaction_keeps_the_view_and_drops_what_may_go(spark):
    ops = random_ops(5000, 300, 9, 0.4)
    df = spark.createDataFrame(ops, OPS).repartition(7)
    ranges = [(b"key-0050", b"key-0099"), (b"key-0090", b"key-0120"), (b"key-0200", b"key-0200")]
    below = spark.createDataFrame(ranges, "smallest binary, largest binary")
    view = live(ops)
    for deeper, kept in ((None, lambda k: False), (below, lambda k: any(a <= k <= b for a, b in ranges))):
        out = compact.merge(df, deeper).collect()
        assert {bytes(r.key): bytes(r.value) for r in out if r.kind == 1} == view
        assert {bytes(r.key) for r in out if r.kind == 0} == {k for _, k, _, _ in ops if k not in view and kept(k)}


def test_doomed_keys_are_gone(spark):
    rows = [(i, b"doomed-%04d" % i, 1, b"x") for i in range(1, 101)] + [(200 + i, b"doomed-%04d" % i, 0, None) for i in range(1, 101)]
    assert compact.merge(spark.createDataFrame(rows, OPS), None).count() == 0


def test_ranges_across_partitions(spark):
    r = random.Random(2)
    keys = [b"%06d" % r.randrange(10**6) for _ in range(400)]
    ranges = [(a, b) for a, b in (sorted((b"%06d" % r.randrange(10**6), b"%06d" % r.randrange(10**6))) for _ in range(4))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = compact.held_below(spark.createDataFrame([(k,) for k in keys], "key binary"), spark.createDataFrame(ranges, "smallest binary, largest binary")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(bytes(x.key) for x in got) == sorted(k for k in keys if any(a <= k <= b for a, b in ranges))


def test_outputs_are_sorted_disjoint_and_bounded(spark):
    ops = [(i, b"k%05d" % i, 1, b"x" * 100) for i in range(2000)]
    out = compact.split_outputs(spark.createDataFrame(ops, OPS), 10_000)
    files = out.groupBy("part", "file_no").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum(F.octet_length("value") + 14).alias("bytes")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(files, files[1:], strict=False))
    assert max(f.bytes for f in files) <= 10_000 + 200 and len(files) >= 20


def test_scores_and_pick(spark):
    mb = 1 << 20
    rows = [(0, i, mb, b"a", b"b") for i in range(4)] + [(1, 10, 10 * mb, b"a", b"b"), (2, 11, 50 * mb, b"a", b"b"), (6, 12, 10**12, b"a", b"b")]
    scores = compact.level_scores(spark.createDataFrame(rows, FILES))
    assert {r.level: r.score for r in scores.collect()} == {0: 1.0, 1: 1.0, 2: 0.5}
    assert [r.level for r in compact.pick_level(scores).collect()] == [1]
    assert compact.pick_level(scores.where("level = 2")).collect() == []
    assert compact.must_stall(spark.createDataFrame(rows * 3, FILES)).first().stalled
    assert not compact.must_stall(spark.createDataFrame(rows, FILES)).first().stalled


def test_rotation_wraps(spark):
    files = spark.createDataFrame([(1, n, 1, b"%d" % n, b"%d" % n) for n in (1, 3, 5)], FILES)
    pick = lambda after: compact.rotation_pick(files, 1, after).first().file_num
    assert [pick(None), pick(b"1"), pick(b"4"), pick(b"5")] == [1, 3, 5, 1]
    assert tuple(bytes(x) for x in compact.key_bounds(files).first()) == (b"1", b"5")


def test_overlap_and_level_faults(spark):
    files = spark.createDataFrame([(1, 1, 1, b"a", b"c"), (1, 2, 1, b"d", b"f"), (2, 3, 1, b"c", b"d"), (2, 4, 1, b"d", b"e"), (0, 5, 1, b"a", b"z"), (0, 6, 1, b"a", b"z")], FILES)
    assert sorted(map(tuple, compact.overlapping(files.where("level = 1"), files.where("level = 2")).collect())) == [(1, 3), (2, 3), (2, 4)]
    assert [tuple(r) for r in compact.level_faults(files).collect()] == [(2, 4, 3)]


def test_manifest_fold(spark):
    e = [(1, "add", 0, 1), (2, "add", 0, 2), (3, "delete", 0, 1), (4, "add", 1, 1), (5, "delete", 0, 2), (6, "add", 0, 2), (7, "add", 0, 2), (8, "delete", 3, 9)]
    edits = spark.createDataFrame([(i, a, lv, n, 10, b"a", b"b") for i, a, lv, n in e], EDITS)
    live_now = compact.live_files(edits)
    assert sorted((r.level, r.file_num) for r in live_now.collect()) == [(0, 2), (1, 1)]
    assert {(r.edit_id, r.fault) for r in compact.edit_faults(edits).collect()} == {(7, "already_there"), (8, "not_there")}
    listing = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "file_num long")
    assert sorted(r.file_num for r in compact.obsolete_files(listing, live_now, spark.createDataFrame([(4,)], "file_num long")).collect()) == [3]


def test_metrics(spark):
    m = spark.createDataFrame([("flush", 260), ("compaction", 600), ("compaction", 18)], "kind string, bytes long")
    assert tuple(compact.maintenance_metrics(m, 200).first()) == (1, 260, 2, 618, 4.39)
    assert tuple(compact.maintenance_metrics(m.where("false")).first()) == (0, 0, 0, 0)


def test_reads_of_the_merged_log(spark):
    ops = random_ops(800, 50, 12)
    merged = compact.merge(spark.createDataFrame(ops, OPS), None)
    assert {bytes(r.key) for r in read.latest_live(merged).collect()} == set(live(ops))


def test_what_to_compact(spark):
    mb = 1 << 20
    level = [(1, 10, 6 * mb, b"a", b"c"), (1, 11, 6 * mb, b"d", b"f"), (1, 12, 1 * mb, b"g", b"i")]
    below = [(2, 20, mb, b"b", b"d"), (2, 21, mb, b"e", b"e"), (2, 22, mb, b"h", b"z"), (3, 30, mb, b"a", b"z")]

    def picked(rows, pointers=None) -> set:
        return {tuple(r) for r in compact.pick_compaction(spark.createDataFrame(rows, FILES), pointers).collect()}

    assert picked(level + below) == {("input", 1, 10), ("next", 2, 20)}
    assert picked(level + below, {1: b"a"}) == {("input", 1, 11), ("next", 2, 20), ("next", 2, 21)}
    assert picked(level + below, {1: b"g"}) == {("input", 1, 10), ("next", 2, 20)}
    fresh = [(0, n, 1, key, key + b"x") for n, key in enumerate((b"a", b"b", b"a", b"k", b"g", b"h"))]
    assert picked(level + below + fresh) == {*(("input", 0, n) for n in range(6)), *(("next", 1, n) for n in (10, 11, 12))}
    assert picked(level[2:] + below) == set() and picked([]) == set()

"""Batches, numbering and exactly-once commands."""

from __future__ import annotations

import random

import pytest

from kvlake.model import BATCHES, COMMANDS
from kvlake.operators import log
from kvlake.sources import raw


@pytest.fixture
def short_ranges(monkeypatch):
    monkeypatch.setattr(log, "RANGE", 7)


def test_numbers_are_dense_and_in_order(spark, short_ranges):
    r = random.Random(1)
    rows = [(i, [(1, b"k%d" % r.randrange(5), b"v") for _ in range(r.randrange(4))]) for i in range(0, 120, 2)] + [(500, None)]
    df = spark.createDataFrame(rows, BATCHES).repartition(4)
    seqs = log.explode_batches(log.number_batches(df)).orderBy("seq").collect()
    assert [x.seq for x in seqs] == list(range(1, sum(len(o or []) for _, o in rows) + 1))
    assert [x.batch_id for x in seqs] == sorted(x.batch_id for x in seqs)
    last = {(x.batch_id, bytes(x.key)): x.seq for x in seqs}
    assert {(x.batch_id, bytes(x.key)): x.seq for x in log.last_in_batch(log.explode_batches(log.number_batches(df))).collect()} == last


def test_a_put_without_value_is_empty_and_a_delete_has_none(spark):
    df = spark.createDataFrame([(0, [(1, b"a", None), (0, b"b", None)])], BATCHES)
    assert [(bytes(x.key), x.value if x.value is None else bytes(x.value)) for x in log.explode_batches(log.number_batches(df)).orderBy("seq").collect()] == [(b"a", b""), (b"b", None)]


def test_faulty_batches(spark):
    rows = [(0, [(1, b"k", b"v")]), (1, [(1, b"k", b"v" * 100)]), (2, [(1, b"\x00!raft/session/1", b"")]), (3, [(2, b"k", None)]), (4, [(0, b"k", b"v")]), (5, [])]
    got = {r.batch_id: r.fault for r in log.batch_faults(spark.createDataFrame(rows, BATCHES), 100).collect()}
    assert got == {0: None, 1: "too_large", 2: "reserved_key", 3: "bad_kind", 4: "bad_value", 5: None}


def test_sizes_are_those_of_the_encoding(spark):
    ops = [(1, b"k" * 130, b"v" * 20_000), (0, b"", None), (1, b"a", None)]
    df = spark.createDataFrame([(0, ops), (1, []), (2, ops * 60)], BATCHES)
    got = {r[0]: r[1] for r in df.select("batch_id", log.encoded_bytes(df["ops"])).collect()}
    assert got == {i: len(raw.encode_batch(1, x)) for i, x in ((0, ops), (1, []), (2, ops * 60))}


def replay(rows):
    """Applied flags, session table and engine sequence numbers, entry by entry."""
    top, applied, used, at = {}, {}, {}, 1
    for index, _, _, client, number, ops in rows:
        ok = client < 0 or number > top.get(client, 0)
        if ok and client >= 0:
            top[client] = number
        n = (len(ops or []) if ok else 0) + (ok and client >= 0) + 1
        applied[index], used[index] = ok, (at, n)
        at += n
    return applied, top, used


def test_exactly_once(spark, short_ranges):
    r = random.Random(4)
    rows = [(i, 1, 0, r.choice([7, 8, 9, -5]), r.randrange(0, 12), [(1, b"k", b"%d" % i)] if r.random() < 0.8 else None) for i in range(1, 200)]
    applied, top, used = replay(rows)
    marked = log.mark_applied(spark.createDataFrame(rows, COMMANDS).repartition(6))
    assert {x.log_index: x.applied for x in marked.collect()} == applied
    assert {x.client_id: x.client_seq for x in log.session_table(marked).collect()} == top
    assert {x.log_index: (x.base_seq, x.n_seqs) for x in log.consumed_seqs(marked).collect()} == used
    ops = log.applied_ops(marked).orderBy("seq").collect()
    assert [bytes(x.value) for x in ops] == [b"%d" % i for i, *_, o in rows if o and applied[i]]


def test_duplicate_and_unnumbered_commands(spark):
    rows = [(1, 1, 0, 7, 5, [(1, b"dup-key", b"first")]), (2, 1, 0, 7, 5, [(1, b"dup-key", b"SECOND")]), (3, 1, 0, 7, 6, [(1, b"next-key", b"yes")]), (4, 1, 0, -9, 1, [(1, b"b", b"1")]), (5, 1, 0, -9, 1, [(1, b"b", b"2")])]
    marked = log.mark_applied(spark.createDataFrame(rows, COMMANDS))
    assert {x.log_index: x.applied for x in marked.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert [tuple(x) for x in log.session_table(marked).collect()] == [(7, 6)]


def test_gaps_and_snapshots(spark, short_ranges):
    have = [i for i in range(100) if i not in (13, 14, 50)]
    df = spark.createDataFrame([(i, i // 10) for i in have], "log_index long, term long")
    assert sorted(map(tuple, log.log_gaps(df).collect())) == [(15, 12), (51, 49)]
    assert tuple(log.snapshot_meta(df).first()) == (99, 9)
    assert log.entries_after(df, 90).count() == 9

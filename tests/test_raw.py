"""Raw file formats: round trips, damage, and reading through Spark."""

from __future__ import annotations

import random

import pytest

from kvlake.functions.hashing import crc32c_table
from kvlake.model import BATCHES, OPS
from kvlake.operators import compact, log, read
from kvlake.sources import raw

from .model import live, random_ops
from .test_reads import GOLDEN


def ordered(ops):
    return sorted(((k, s, kind, v) for s, k, kind, v in ops), key=lambda e: (e[0], -e[1]))


def test_checksums():
    def plain(data: bytes) -> int:
        crc = 0xFFFFFFFF
        for b in data:
            crc = crc >> 8 ^ crc32c_table()[(crc ^ b) & 255]
        return crc ^ 0xFFFFFFFF

    parts = [random.Random(n).randbytes(n) for n in (0, 1, 5, 5, 300, 17)]
    assert raw.crc32c_all(parts) == [plain(p) for p in parts]
    assert raw.crc32c_all([b"123456789"]) == [0xE3069283]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 2**32, 2**64 - 1])
def test_numbers(n):
    assert raw.Cursor(raw.number_bytes(n)).number() == n


def test_numbers_that_are_too_long():
    for bad in (b"", b"\x80", b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x7f"):
        with pytest.raises(raw.Corrupt):
            raw.Cursor(bad).number()


def test_batches_decode_whole_or_not_at_all():
    ops = [(1, b"a", b""), (0, b"", None), (1, b"k" * 200, b"v" * 1000)]
    body = raw.encode_batch(7, ops)
    assert raw.decode_batch(body) == (7, ops)
    for cut in range(len(body)):
        with pytest.raises(raw.Corrupt):
            raw.decode_batch(body[:cut])
    for bad in (body + b"x", body[:9] + b"\x02" + body[10:], body[:8] + raw.number_bytes(10**9)):
        with pytest.raises(raw.Corrupt):
            raw.decode_batch(bad)
    assert raw.decode_command(raw.encode_command(-5, 9, ops)) == (-5, 9, ops)


def test_torn_records():
    payloads = [b"", b"abc", b"x" * 100]
    data = b"".join(map(raw.frame, payloads))
    assert raw.unframe(data) == (payloads, len(data))
    for cut in range(len(data)):
        found, clean = raw.unframe(data[:cut])
        assert found == payloads[: len(found)] and clean == sum(len(p) + 8 for p in found)
    for at in range(len(data)):
        assert len(raw.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])[0]) < 3


def test_tables():
    for ops in (GOLDEN, random_ops(3000, 200, 2), []):
        body = raw.build_table(ordered(ops))
        table = raw.parse_table(body)
        assert table.entries == ordered(ops)
        assert all(raw.may_contain(table.bloom, k) for _, k, _, _ in ops)
    many = [b"%d" % i for i in range(2000)]
    bloom = raw.bloom_filter(many)
    assert sum(raw.may_contain(bloom, b"no%d" % i) for i in range(5000)) < 200
    assert raw.may_contain(b"", b"x") and raw.may_contain(b"\x00\x1f", b"x")
    with pytest.raises(ValueError):
        raw.build_table(ordered(GOLDEN)[::-1])
    body = raw.build_table(ordered(GOLDEN))
    for at in range(len(body)):
        with pytest.raises(raw.Corrupt):
            raw.parse_table(body[:at] + bytes([body[at] ^ 4]) + body[at + 1 :])


def test_shard_maps():
    slots = [(10 + s % 3, s % 17 == 0) for s in range(256)]
    body = raw.encode_shard_map(5, slots)
    assert raw.decode_shard_map(body) == (5, slots)
    for bad in (body[:-1], body + b"x", b"123"):
        with pytest.raises(raw.Corrupt):
            raw.decode_shard_map(bad)


def test_log_folder(spark, tmp_path):
    ops = random_ops(300, 30, 4)
    for i in range(3):
        body = b"".join(raw.frame(raw.encode_batch(s, [(kind, k, v)])) for s, k, kind, v in ops[i * 100 : i * 100 + 100])
        (tmp_path / f"{i + 1:06d}.wal").write_bytes(body + (b"torn" if i == 2 else b""))
    got = raw.read_log(spark, str(tmp_path))
    assert got.count() == 300
    assert {bytes(r.key): bytes(r.value) for r in read.latest_live(got).collect()} == live(ops)
    (tmp_path / "000004.wal").write_bytes(b"")
    with pytest.raises(raw.Corrupt, match="segment 000003: corrupt"):
        raw.read_log(spark, str(tmp_path))
    assert [(r.segment, r.fault) for r in raw.segment_faults(raw.segments(spark, str(tmp_path)), 4).collect()] == [(3, "corrupt")]
    assert raw.read_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "000003.wal").unlink()
    with pytest.raises(raw.Corrupt, match="missing"):
        raw.read_log(spark, str(tmp_path))


def test_table_files(spark, tmp_path):
    ops = random_ops(2000, 400, 5)
    outputs = compact.split_outputs(compact.merge(spark.createDataFrame(ops, OPS), None), 1000)
    for r in raw.table_files(outputs).collect():
        (tmp_path / f"{r.part:03d}{r.file_no:03d}.sst").write_bytes(r.content)
    got = raw.read_tables(spark, str(tmp_path))
    assert {bytes(r.key): bytes(r.value) for r in got.collect()} == live(ops)
    assert got.select("file").distinct().count() > 3


def test_manifest(spark, tmp_path):
    key = lambda k: raw.sized_bytes(raw.internal_key(k, 1, 1))
    add = lambda level, n: bytes([4, level]) + raw.number_bytes(n) + raw.number_bytes(1000) + key(b"a") + key(b"z")
    edits = [bytes([1, 3, 2, 9, 3, 7]) + add(0, 1), add(0, 2) + bytes([5, 0, 1]), add(1, 1)]
    (tmp_path / "MANIFEST").write_bytes(b"".join(map(raw.frame, edits)))
    found = raw.read_manifest(spark, str(tmp_path / "MANIFEST"))
    assert {(r.action, r.number) for r in found.where("number is not null").collect()} == {("log_number", 3), ("next_file_num", 9), ("last_seq", 7)}
    now = compact.live_files(found.where("action in ('add', 'delete')"))
    assert sorted((r.level, r.file_num, bytes(r.largest)) for r in now.collect()) == [(0, 2, b"z"), (1, 1, b"z")]
    for bad in (bytes([9]), bytes([4, 7]), bytes([5, 0])):
        with pytest.raises(raw.Corrupt):
            raw.decode_edit(bad)


def test_replica_state(spark, tmp_path):
    e = lambda i, t, data=b"x": (0, i, t, data)
    hard = bytes([1]) + bytes(8) + (3).to_bytes(8, "little") + (2).to_bytes(8, "little")
    records = [raw.encode_entries([e(1, 1), e(2, 1), e(3, 1)]), hard, raw.encode_entries([e(2, 2, b"y")]), raw.encode_entries([e(3, 2), e(4, 2)]), bytes([3]) + (4).to_bytes(8, "little")]
    state = raw.replay_state(records)
    assert (state.vote, state.commit, sorted(state.entries.values())) == (3, 2, [e(1, 1), e(2, 2, b"y"), e(3, 2)])
    snapshot = bytes([4]) + (7).to_bytes(8, "little") + (1).to_bytes(8, "little")
    assert list(raw.replay_state([snapshot, raw.encode_entries([e(8, 1)])]).entries) == [8]
    for bad in ([raw.encode_entries([e(2, 1)])], [snapshot, raw.encode_entries([e(7, 1)])], [records[0], snapshot], [bytes([9])], [hard[:-1]], [hard + b"x"], [b""]):
        with pytest.raises(raw.Corrupt):
            raw.replay_state(bad)
    ops = [(1, b"k", b"v"), (0, b"d", None)]
    log = [(0, 1, 1, raw.encode_command(7, 1, ops)), (0, 2, 1, b""), (1, 3, 1, b"member"), (0, 4, 1, raw.encode_command(7, 1, ops))]
    for i in range(3):
        (tmp_path / f"node{i}").write_bytes(raw.frame(raw.encode_entries(log)) + b"torn")
    got = raw.read_replicas(spark, str(tmp_path))
    from kvlake.operators import audit
    from kvlake.operators import log as logs

    assert got.count() == 12 and audit.log_conflicts(got).count() == 0
    one = got.where("file like '%node0'")
    marked = logs.mark_applied(raw.commands_of(one))
    assert {r.log_index: (r.client_id, r.ops and len(r.ops), r.applied) for r in marked.collect()} == {1: (7, 2, True), 2: (None, None, False), 3: (None, None, False), 4: (7, 2, False)}
    assert [(r.seq, bytes(r.key)) for r in logs.applied_ops(marked).orderBy("seq").collect()] == [(1, b"k"), (2, b"d")]


def test_tables_read_by_parts():
    r = random.Random(12)
    entries = ordered([(i, b"key-%05d" % r.randrange(0, 4000, 2), r.randrange(2), b"v%d" % i) for i in range(3000)])
    entries = [(k, s, kind, v if kind else None) for k, s, kind, v in entries]
    data = raw.build_table(entries, 512)
    table = raw.OpenTable(data)
    for start in (b"", b"key-00000", b"key-01001", b"key-03999", b"zzz"):
        assert list(table.from_key(start)) == [e for e in entries if e[0] >= start]
    newest = {e[0]: e for e in reversed(entries)}
    for i in range(4000):
        assert table.newest(b"key-%05d" % i) == newest.get(b"key-%05d" % i)
    late = bytearray(data)
    late[10] ^= 1  # in the first block: what lies after it can still be read
    assert list(raw.OpenTable(bytes(late)).from_key(b"key-03000")) == [e for e in entries if e[0] >= b"key-03000"]
    with pytest.raises(raw.Corrupt):
        list(raw.OpenTable(bytes(late)).from_key(b""))
    for bad in (b"", data[:-1], data[:-20] + b"\xff" + data[-19:]):
        with pytest.raises(raw.Corrupt):
            raw.OpenTable(bad)


def test_edits_round_trip():
    rows = [
        {"action": "last_seq", "number": 2**40},
        {"action": "add", "level": 6, "file_num": 300, "size": 0, "smallest": b"", "largest": b"\xff\x00"},
        {"action": "delete", "level": 0, "file_num": 7},
    ]
    assert raw.decode_edit(raw.encode_edit(rows)) == rows
    with pytest.raises(ValueError, match="level 7"):
        raw.encode_edit([{"action": "delete", "level": 7, "file_num": 1}])


def test_written_segments_read_like_any_log(spark, tmp_path):
    ops = random_ops(500, 60, 31)
    by_batch = [(i, [{"kind": kind, "key": k, "value": v} for _, k, kind, v in ops[i * 5 : i * 5 + 5]] if i != 7 else []) for i in range(100)]
    numbered = log.number_batches(spark.createDataFrame(by_batch, BATCHES))
    found = raw.log_segments(numbered, 1000).collect()
    assert [r.segment for r in sorted(found)] == list(range(1, len(found) + 1)) and len(found) > 5
    for r in found:
        (tmp_path / f"{r.segment:06d}.wal").write_bytes(r.content)
    kept = ops[:35] + ops[40:]
    want = [(i + 1, k, kind, v) for i, (_, k, kind, v) in enumerate(kept)]
    assert sorted((r.seq, bytes(r.key), r.kind, None if r.value is None else bytes(r.value)) for r in raw.read_log(spark, str(tmp_path)).collect()) == want
    left = raw.after_prune(spark.createDataFrame([(1,), (2,), (3,)], "segment long"), 9).collect()
    assert [r.segment for r in left] == [3]

"""Raw files in bulk: work that grows with the input only, and results as by the plain ways."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.functions.hashing import crc32c_table
from kvlake.model import BATCHES
from kvlake.operators import log
from kvlake.plans import formats
from kvlake.sources import raw


def test_checksums_of_long_parts():
    def plain(data: bytes) -> int:
        crc = 0xFFFFFFFF
        for b in data:
            crc = crc >> 8 ^ crc32c_table()[(crc ^ b) & 255]
        return crc ^ 0xFFFFFFFF

    r = random.Random(3)
    parts = [r.randbytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 127, 128, 4095, 4096, 4097, 20_000)]
    r.shuffle(parts)
    assert raw.crc32c_all(parts) == [plain(p) for p in parts]
    assert raw.crc32c_all([]) == []


def test_keys_in_order_read_a_block_once(monkeypatch):
    table = raw.OpenTable(raw.build_table([(b"key-%05d" % i, i, 1, b"v") for i in range(2000)], 512))
    read, block = [], raw.OpenTable.block
    monkeypatch.setattr(raw.OpenTable, "block", lambda self, at, size: read.append(at) or block(self, at, size))
    assert all(table.newest(b"key-%05d" % i) == (b"key-%05d" % i, i, 1, b"v") for i in range(2000))
    assert len(read) == len(table.handles)


def test_look_up_meets_files_without_pairs(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(raw, "LOOK_UP_BLOCK", 16)  # keys of a file span several blocks
    made = {f"f{n}": {b"key-%04d" % i: n * 1000 + i for i in range(start, start + span, 2)} for n, (start, span) in enumerate([(0, 200), (100, 300), (150, 2), (500, 400), (500, 400), (2000, 10)])}
    bodies = [(path, raw.build_table([(k, s, 1, b"v%d" % s) for k, s in sorted(pairs.items())])) for path, pairs in made.items()] + [("empty", raw.build_table([]))]
    files = spark.createDataFrame(bodies, "path string, content binary")
    keys = [b"key-%04d" % r.randrange(1000) for _ in range(400)] + [b"", b"zzz", b"key-0000", b"key-0198"]
    found = raw.look_up(files, spark.createDataFrame([(k,) for k in [*keys, None]], "key binary"))
    want = sorted((path, pairs[k], k, b"v%d" % pairs[k]) for path, pairs in made.items() for k in set(keys) if k in pairs)
    assert sorted((x.file, x.seq, bytes(x.key), bytes(x.value)) for x in found.collect()) == want and len(want) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


OPS_TYPE = pa.list_(pa.struct([("kind", pa.int8()), ("key", pa.binary()), ("value", pa.binary())]))


def some_batches(r: random.Random, n: int, most: int) -> list[list[dict]]:
    size = lambda: r.randbytes(r.choice([0, 1, 20, 127, 128, 300]))
    return [[{"kind": r.choice([0, 1, 1]), "key": size(), "value": r.choice([None, b"", size(), r.randbytes(20_000)])} for _ in range(r.randrange(1, most))] for _ in range(n)]


def plain(batches: list[list[dict]], base: list[int]) -> list[bytes]:
    return [raw.encode_batch(b, [(o["kind"], o["key"], o["value"]) for o in ops]) for b, ops in zip(base, batches, strict=True)]


@pytest.mark.parametrize(("n", "most"), [(1, 2), (60, 4), (150, 9), (40, 160)])
def test_batches_side_by_side(n, most):
    batches = some_batches(random.Random(n), n, most)
    base = np.cumsum([len(b) for b in batches])
    bodies = raw.encode_ops(pa.array([[{"kind": 0, "key": b"cut off", "value": None}], *batches], OPS_TYPE).slice(1))
    content = raw.frame_batches(base, bodies)
    payloads = plain(batches, base.tolist())
    assert content == raw.frames(payloads) and raw.unframe(content) == (payloads, len(content))
    made = raw.decode_batches(content, raw._records(content))
    want = [(b + i, k, kind, v) for b, ops in map(raw.decode_batch, payloads) for i, (kind, k, v) in enumerate(ops)]
    assert (made is None) == (n == 1)  # one batch by itself is left to the plain way
    assert made is None or [tuple(x.values()) for x in made.to_pylist()] == want


def test_damaged_batches_are_left_to_the_plain_way():
    r = random.Random(9)
    payloads = plain([[{"kind": r.randrange(2), "key": b"k" * r.choice([3, 130]), "value": b"v"} for _ in range(3)] for _ in range(40)], list(range(40)))
    for _ in range(600):
        at = r.randrange(40)
        bad = bytearray(payloads[at])
        bad[r.randrange(8, len(bad))] ^= 1 << r.randrange(8)
        bad = bytes(bad) if r.random() < 0.7 else payloads[at][: r.randrange(len(payloads[at]))]
        content = raw.frames([*payloads[:at], bad, *payloads[at + 1 :]])
        made = raw.decode_batches(content, raw._records(content))
        try:
            want = raw.decode_batch(bad)[1]
        except raw.Corrupt:
            assert made is None
        else:
            ops = [(x["kind"], x["key"], x["value"]) for x in made.to_pylist()][at * 3 :] if made else want
            assert ops[: len(want)] == want and (made is None or made.num_rows == 39 * 3 + len(want))


def test_bad_ops_are_not_written():
    for bad in ({"kind": None, "key": b"a", "value": b""}, {"kind": 1, "key": None, "value": b""}, {"kind": -1, "key": b"a", "value": b""}):
        with pytest.raises(ValueError):
            raw.encode_ops(pa.array([[bad]], OPS_TYPE))


def test_batches_are_made_once_for_a_log(spark):
    batches = some_batches(random.Random(4), 200, 5)
    rows = [(i * 3, None if i == 5 else [] if i == 7 else b) for i, b in enumerate(batches)]
    seen = spark.sparkContext.accumulator(0)

    def watched(found):
        for batch in found:
            seen.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(rows, BATCHES).mapInArrow(watched, BATCHES)
    found = sorted(raw.log_segments(source, 20_000).collect())
    assert seen.value == 200
    kept = [b for i, b in enumerate(batches) if i not in (5, 7)]
    base = [1 + sum(map(len, kept[:i])) for i in range(len(kept))]
    assert b"".join(bytes(x.content) for x in found) == raw.frames(plain(kept, base))
    assert [x.segment for x in found] == list(range(1, len(found) + 1)) and len(found) > 5
    assert [x.newest for x in found] == [False] * (len(found) - 1) + [True]
    assert [x.first_seq for x in found[1:]] == [x.last_seq + 1 for x in found[:-1]] and sum(x.batches for x in found) == 198
    again = raw.log_segments(log.number_batches(spark.createDataFrame(rows, BATCHES)).withColumn("base_seq", F.col("base_seq") + 1000), 20_000).collect()
    assert [x.first_seq for x in sorted(again)] == [x.first_seq + 1000 for x in found]


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Columns of what a query writes to cut lineage."""
    columns, cut = [], formats.cut
    monkeypatch.setattr(formats, "cut", lambda df: columns.append(df.columns) or cut(df))
    return columns


def test_pruning_keeps_numbers_only(spark, written):
    assert formats.log_prune(spark, FOLDER).count() > 0
    assert written == [["segment", "last_seq"]]


def test_torn_tail_writes_no_copy_of_the_log(spark, written):
    assert formats.torn_log_tail(spark, FOLDER).count() > 0
    assert written == []


def test_rotation_makes_its_batches_once(spark, monkeypatch):
    seen, made = spark.sparkContext.accumulator(0), formats.views.batches_from_lineitem

    def watched(found):
        for batch in found:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(formats.views, "batches_from_lineitem", lambda *a: made(*a).mapInArrow(watched, BATCHES))
    batches = sum(x.batches for x in formats.log_rotation(spark, FOLDER).collect())
    assert seen.value == batches > 1000

"""Raw files of an embedded store: log segments, sorted tables, manifests, shard maps and commands.

Files are read whole by Spark's ``binaryFile`` source (they are a few MB each) and parsed by Arrow
batches; damage is an error that names the file, except for the torn end of the newest log segment.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.functions.hashing import crc32c_table
from kvlake.model import DELETE, LEVELS, PUT, SLOTS
from kvlake.operators.log import running_totals
from kvlake.plans.lineage import cut, scratch

# Fixed values of the formats.
TABLE_MAGIC, TABLE_VERSION, FOOTER_BYTES = 0xBA5A17557AB1E000, 1, 48
BLOCK_BYTES, RESTART_EVERY, BITS_PER_KEY = 4096, 16, 10
BLOOM_SEED, BLOOM_FACTOR, BLOOM_MOST_PROBES = 0xBC9F1D34, 0xC6A4A793, 30
MAX_SEQ = (1 << 56) - 1
SEGMENT_NAME = r"(\d{6,})\.wal$"
TAG_LOG, TAG_NEXT_FILE, TAG_LAST_SEQ, TAG_ADD, TAG_DELETE = 1, 2, 3, 4, 5


class Corrupt(ValueError):
    """Bytes that no writer makes."""


_CRC = np.array(crc32c_table(), dtype=np.uint32)
#: Bytes of a piece whose checksum is made on its own; longer parts have longer pieces.
PIECE_BYTES = 64


def _spread(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of a linear map of 32 bits, given what it makes of each bit: one for the low half of a number, one for the high half."""
    tables = []
    for half in (images[:16], images[16:]):
        table = np.zeros(1, dtype=np.uint32)
        for image in half:
            table = np.concatenate((table, table ^ image))
        tables.append(table)
    return tables[0], tables[1]


@lru_cache(maxsize=64)
def _zeros(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` bytes of zero, a power of two, make of a checksum's state."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 1:
        return _spread(state >> np.uint32(8) ^ _CRC[state & np.uint32(255)])
    low, high = _zeros(n // 2)
    for _ in range(2):
        state = low[state & np.uint32(0xFFFF)] ^ high[state >> np.uint32(16)]
    return _spread(state)


def crc32c_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of each span of ``data``.

    Spans are cut into pieces of one length, the first a shorter one; all pieces go side by side, a word at a
    time, and are then put together. The steps grow with the root of the longest span.
    """
    if not len(sizes):
        return np.empty(0, dtype=np.uint32)
    starts, sizes = starts.astype(np.int64), sizes.astype(np.int64)
    piece = np.full(len(sizes), PIECE_BYTES, dtype=np.int64)
    for i in np.flatnonzero(sizes > PIECE_BYTES**2):
        piece[i] = 1 << (int(sizes[i]).bit_length() + 1) // 2
    count = np.maximum(-(-sizes // piece), 1)
    head = sizes - (count - 1) * piece
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(of)) - first[of]
    length = np.where(nth == 0, head[of], piece[of])
    begin = starts[of] + np.where(nth == 0, 0, head[of] + (nth - 1) * piece[of])
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], begin[order]
    state = np.where(nth == 0, 0xFFFFFFFF, 0).astype(np.uint32)[order]
    whole, half, low_byte = length >> 2, np.uint32(16), np.uint32(255)
    low, high = _zeros(4)
    words = np.ndarray((max(len(data) - 3, 0),), "<u4", data, strides=(1,)).copy()  # one at every byte
    for n in np.searchsorted(-whole, -np.arange(int(whole[0])), side="left").tolist():  # pieces with more words
        x = state[:n] ^ words[begin[:n]]
        state[:n] = low[x & np.uint32(0xFFFF)] ^ high[x >> half]
        begin[:n] += 4
    for j in range(3):
        left = np.flatnonzero((length & 3) > j)
        state[left] = state[left] >> np.uint32(8) ^ _CRC[(state[left] ^ data[begin[left] + j]) & low_byte]
    made = np.empty_like(state)
    made[order] = state
    out = made[first]
    for size in np.unique(piece[count > 1]).tolist():
        low, high = _zeros(size)
        some = np.flatnonzero((piece == size) & (count > 1))
        some = some[np.argsort(-count[some], kind="stable")]
        for j, n in enumerate(np.searchsorted(-count[some], -np.arange(1, int(count[some[0]])), side="left").tolist(), 1):  # spans with more pieces
            x = out[some[:n]]
            out[some[:n]] = low[x & np.uint32(0xFFFF)] ^ high[x >> half] ^ made[first[some[:n]] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c_all(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part, all of them side by side."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    return crc32c_spans(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size).tolist()


class Cursor:
    """Reads forward through bytes; running out is corruption."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def __bool__(self) -> bool:
        return self.at < self.end

    def take(self, n: int) -> bytes:
        if n > self.end - self.at:
            raise Corrupt("bytes end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A base-128 number, low part first."""
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                if out >> 64:
                    raise Corrupt("number of more than 64 bits")
                return out
            shift += 7
            if shift > 63:
                raise Corrupt("number of more than 64 bits")

    def sized(self) -> bytes:
        return self.take(self.number())

    def u64(self) -> int:
        return int.from_bytes(self.take(8), "little")


def number_bytes(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def sized_bytes(value: bytes) -> bytes:
    return number_bytes(len(value)) + value


# -- records, batches, commands


def frame(payload: bytes) -> bytes:
    return frames([payload])


def frames(payloads: list[bytes]) -> bytes:
    """Records, one after another; their checksums are made side by side."""
    sized = [struct.pack("<I", len(p)) + p for p in payloads]
    return b"".join(struct.pack("<I", crc) + body for crc, body in zip(crc32c_all(sized), sized, strict=True))


def _records(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of each record in the clean start of a file."""
    spans, at = [], 0
    while len(data) - at >= 8:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if size > len(data) - at - 8:
            break
        spans.append((at, at + 8 + size))
        at += 8 + size
    if not spans:
        return []
    body, (begin, end) = np.frombuffer(data, np.uint8), np.array(spans).T
    bad = np.flatnonzero(crc32c_spans(body, begin + 4, end - begin - 4) != _fixed(body, begin, 4))
    return spans[: bad[0]] if len(bad) else spans


def unframe(data: bytes) -> tuple[list[bytes], int]:
    """The payloads of the clean start of a file, and its length."""
    spans = _records(data)
    return [data[a + 8 : b] for a, b in spans], spans[-1][1] if spans else 0


Op = tuple[int, bytes, bytes | None]


def encode_batch(base_seq: int, ops: list[Op]) -> bytes:
    body = b"".join(bytes([kind]) + sized_bytes(key) + (sized_bytes(value or b"") if kind == PUT else b"") for kind, key, value in ops)
    return struct.pack("<Q", base_seq) + number_bytes(len(ops)) + body


def decode_batch(payload: bytes) -> tuple[int, list[Op]]:
    """All of a batch or an error."""
    c = Cursor(payload)
    base, count, ops = c.u64(), c.number(), []
    for _ in range(count):
        kind = c.take(1)[0]
        if kind not in (DELETE, PUT):
            raise Corrupt(f"kind {kind}")
        key = c.sized()
        ops.append((kind, key, c.sized() if kind == PUT else None))
    if c:
        raise Corrupt("bytes after the batch")
    return base, ops


# The same for many batches at once, in arrays: byte i of all numbers, op i of all batches.


def _fixed(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers of ``n`` bytes, low byte first."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        out |= data[at + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _put_fixed(data: np.ndarray, at: np.ndarray, numbers: np.ndarray, n: int) -> None:
    for i in range(n):
        data[at + i] = numbers >> np.asarray(8 * i, numbers.dtype) & np.asarray(255, numbers.dtype)


def _number_sizes(n: np.ndarray) -> np.ndarray:
    """Bytes of base-128 numbers below 2**35."""
    return 1 + sum((n >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))


def _put_numbers(data: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> None:
    size = _number_sizes(numbers)
    for i in range(int(size.max(initial=0))):
        some = size > i
        data[at[some] + i] = numbers[some] >> 7 * i & 127 | np.where(size[some] > i + 1, 128, 0)


def _places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of spans, one span after another."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the size of each value."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends).astype(np.int64)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of values that lie one after another."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one column")
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode_ops(column: pa.ListArray) -> pa.Array:
    """Of each list of ops (kind, key, value) its count and ops, as in a batch after its base; the lists are not null."""
    ops = column.flatten()
    counts = np.asarray(pc.list_value_length(column)).astype(np.int64)
    kinds, keys, values = (pc.struct_field(ops, i) for i in range(3))
    if kinds.null_count or keys.null_count:
        raise ValueError("an op without kind or key")
    kind = np.asarray(kinds).astype(np.int64)
    if ((kind < 0) | (kind > 255)).any():
        raise ValueError("kind out of range")
    put = kind == PUT
    key, key_sizes = _bytes_of(keys.cast(pa.binary()))
    value, value_sizes = _bytes_of(pc.if_else(pa.array(put), pc.fill_null(values, b""), b"").cast(pa.binary()))
    key_head, value_head = _number_sizes(key_sizes), np.where(put, _number_sizes(value_sizes), 0)
    op_sizes = 1 + key_head + key_sizes + value_head + value_sizes
    upto = np.concatenate(([0], np.cumsum(op_sizes)))
    last = np.cumsum(counts)
    heads = _number_sizes(counts)
    sizes = heads + upto[last] - upto[last - counts]
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin + heads - upto[last - counts], counts) + upto[:-1]
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    _put_numbers(out, begin, counts)
    out[at] = kind
    _put_numbers(out, at + 1, key_sizes)
    out[_places(at + 1 + key_head, key_sizes)] = key
    _put_numbers(out, (at + 1 + key_head + key_sizes)[put], value_sizes[put])
    out[_places(at + 1 + key_head + key_sizes + value_head, value_sizes)] = value
    return _binary(out, sizes)


def frame_batches(base_seq: np.ndarray, bodies: pa.Array) -> bytes:
    """Records of batches, given their first numbers and what ``encode_ops`` made of their ops."""
    body, sizes = _bytes_of(bodies)
    begin = np.cumsum(sizes + 16) - sizes - 16
    out = np.empty(int((sizes + 16).sum()), dtype=np.uint8)
    _put_fixed(out, begin + 4, sizes + 8, 4)
    _put_fixed(out, begin + 8, base_seq, 8)
    out[_places(begin + 16, sizes)] = body
    _put_fixed(out, begin, crc32c_spans(out, begin + 4, sizes + 12), 4)
    return out.tobytes()


def _numbers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base-128 numbers and where they end; one of more than five bytes gets an end beyond the data."""
    out, at, open_ = np.zeros(len(at), dtype=np.int64), at.copy(), np.arange(len(at))
    for i in range(5):
        byte = data[np.minimum(at[open_], len(data) - 1)].astype(np.int64)
        out[open_] |= (byte & 127) << 7 * i
        at[open_] += 1
        open_ = open_[byte > 127]
        if not len(open_):
            return out, at
    at[open_] = len(data) + 1
    return out, at


#: Batches that are decoded side by side, on average, for arrays to be worth it.
SIDE_BY_SIDE = 8


def decode_batches(content: bytes, spans: list[tuple[int, int]]) -> pa.RecordBatch | None:
    """seq, key, kind, value of the ops of batches in their records; None if one is damaged or unusual, or they are few and long: ``decode_batch`` sees to those."""
    data = np.frombuffer(content, np.uint8)
    begin, end = np.array(spans, dtype=np.int64).T
    if (end - begin < 17).any():
        return None
    base = _fixed(data, begin + 8, 8)
    counts, at = _numbers(data, begin + 16)
    total, most = int(counts.sum()), int(counts.max())
    if (at > end).any() or total > len(data) or total < SIDE_BY_SIDE * most or int(base.max()) >> 62:
        return None
    first = np.cumsum(counts) - counts
    kind, key_at, key_size, value_at, value_size = (np.zeros(total, dtype=np.int64) for _ in range(5))
    order = np.argsort(-counts, kind="stable")
    for i, n in enumerate(np.searchsorted(-counts[order], -np.arange(most), side="left").tolist()):  # batches with more ops
        of = order[:n]
        place, here, stop = first[of] + i, at[of], end[of]
        if (here >= stop).any():
            return None
        found = data[here]
        size, here = _numbers(data, here + 1)
        if (found > PUT).any() or (here + size > stop).any():
            return None
        kind[place], key_at[place], key_size[place] = found, here, size
        here = here + size
        put = found == PUT
        size, behind = _numbers(data, here[put])
        if (behind + size > stop[put]).any():
            return None
        value_at[place[put]], value_size[place[put]] = behind, size
        here[put] = behind + size
        at[of] = here
    if (at != end).any():
        return None
    seq = np.repeat(base.astype(np.int64) - first, counts) + np.arange(total)
    values = _binary(data[_places(value_at, value_size)], value_size)
    columns = [pa.array(seq), _binary(data[_places(key_at, key_size)], key_size), pa.array(kind.astype(np.int8)), pc.if_else(pa.array(kind == PUT), values, pa.scalar(None, pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["seq", "key", "kind", "value"])


def encode_command(client: int, number: int, ops: list[Op]) -> bytes:
    return struct.pack("<QQ", client % (1 << 64), number) + encode_batch(0, ops)


def decode_command(data: bytes) -> tuple[int, int, list[Op]]:
    """Client id (as signed), its number, and the ops."""
    c = Cursor(data)
    client, number = c.u64(), c.u64()
    return client - (1 << 64) if client >> 63 else client, number, decode_batch(data[16:])[1]


# -- tables


def internal_key(key: bytes, seq: int, kind: int) -> bytes:
    if not 0 <= seq <= MAX_SEQ or kind not in (DELETE, PUT):
        raise ValueError(f"seq {seq}, kind {kind}")
    return key + struct.pack("<Q", seq << 8 | kind)


def split_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise Corrupt("key without trailer")
    trailer = int.from_bytes(data[-8:], "little")
    if trailer & 255 not in (DELETE, PUT):
        raise Corrupt(f"kind {trailer & 255}")
    return data[:-8], trailer >> 8, trailer & 255


def bloom_hash(key: bytes) -> int:
    mask, m = 0xFFFFFFFF, BLOOM_FACTOR
    h = (BLOOM_SEED ^ len(key) * m) & mask
    whole = len(key) & ~3
    for (word,) in struct.iter_unpack("<I", key[:whole]):
        h = (h + word) * m & mask
        h ^= h >> 16
    if whole < len(key):
        h = (h + int.from_bytes(key[whole:], "little")) * m & mask
        h ^= h >> 24
    return h


def _probes(h: int, n: int, bits: int) -> Iterator[int]:
    step = (h >> 17 | h << 15) & 0xFFFFFFFF
    for _ in range(n):
        yield h % bits
        h = (h + step) & 0xFFFFFFFF


def bloom_filter(keys: list[bytes], bits_per_key: int = BITS_PER_KEY) -> bytes:
    n = min(max(int(bits_per_key * 0.69), 1), BLOOM_MOST_PROBES)
    body = bytearray((max(len(keys) * bits_per_key, 64) + 7) // 8)
    for key in keys:
        for bit in _probes(bloom_hash(key), n, len(body) * 8):
            body[bit // 8] |= 1 << bit % 8
    return bytes(body) + bytes([n])


def may_contain(bloom: bytes, key: bytes) -> bool:
    """False only if the key isn't there; a filter that makes no sense says maybe."""
    bits = (len(bloom) - 1) * 8 % (1 << 32)
    if len(bloom) < 2 or not bits or bloom[-1] > BLOOM_MOST_PROBES:
        return True
    return all(bloom[b // 8] >> b % 8 & 1 for b in _probes(bloom_hash(key), bloom[-1], bits))


@dataclass
class _Block:
    every: int
    body: bytearray = field(default_factory=bytearray)
    restarts: list[int] = field(default_factory=list)
    count: int = 0
    last: bytes = b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % self.every == 0:
            self.restarts.append(len(self.body))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.body += number_bytes(shared) + number_bytes(len(key) - shared) + number_bytes(len(value)) + key[shared:] + value
        self.count += 1
        self.last = key

    def size(self) -> int:
        return len(self.body) + 4 * len(self.restarts) + 4

    def done(self) -> bytes:
        marks = self.restarts or [0]
        return bytes(self.body) + struct.pack(f"<{len(marks) + 1}I", *marks, len(marks))


def build_table(entries: list[tuple[bytes, int, int, bytes | None]], block_bytes: int = BLOCK_BYTES) -> bytes:
    """A table file of (key, seq, kind, value) in strictly ascending order of (key, newest first)."""
    parts, data, index = [], _Block(RESTART_EVERY), _Block(1)
    before, end = None, 0

    def put(contents: bytes) -> tuple[int, int]:
        nonlocal end
        parts.append(contents)
        end += len(contents) + 4
        return end - len(contents) - 4, len(contents)

    def flush() -> None:
        nonlocal data
        if data.count:
            at, size = put(data.done())
            index.add(data.last, number_bytes(at) + number_bytes(size))
            data = _Block(RESTART_EVERY)

    for key, seq, kind, value in entries:
        place = (key, -seq, -kind)
        if before is not None and place <= before:
            raise ValueError(f"out of order: {key!r} {seq}")
        before = place
        data.add(internal_key(key, seq, kind), value or b"")
        if data.size() >= block_bytes:
            flush()
    flush()
    bloom, top = put(bloom_filter([e[0] for e in entries])), None
    top = put(index.done())
    foot = struct.pack("<QQQQI", *bloom, *top, TABLE_VERSION)
    *sums, foot_sum = crc32c_all([*parts, foot])
    blocks = b"".join(part + struct.pack("<I", crc) for part, crc in zip(parts, sums, strict=True))
    return blocks + foot + struct.pack("<IQ", foot_sum, TABLE_MAGIC)


def _entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a block."""
    if len(block) < 8:
        raise Corrupt("block of less than 8 bytes")
    n = int.from_bytes(block[-4:], "little")
    if not 1 <= n <= (len(block) - 4) // 4:
        raise Corrupt("restart count")
    c, key = Cursor(block, 0, len(block) - 4 - 4 * n), b""
    while c:
        shared, own, size = c.number(), c.number(), c.number()
        if shared > len(key):
            raise Corrupt("shared prefix")
        key = key[:shared] + c.take(own)
        yield key, c.take(size)


@dataclass(frozen=True)
class Table:
    entries: list[tuple[bytes, int, int, bytes | None]]
    bloom: bytes


def parse_table(data: bytes) -> Table:
    """All entries of a table file, its checksums and order verified."""
    if len(data) < FOOTER_BYTES or int.from_bytes(data[-8:], "little") != TABLE_MAGIC:
        raise Corrupt("no table")
    foot = data[-FOOTER_BYTES:]
    if crc32c_all([foot[:36]])[0] != int.from_bytes(foot[36:40], "little"):
        raise Corrupt("footer checksum")
    bloom_at, bloom_size, index_at, index_size, version = struct.unpack("<QQQQI", foot[:36])
    if version != TABLE_VERSION:
        raise Corrupt(f"version {version}")

    def span(at: int, size: int) -> tuple[int, int]:
        if at + size + 4 > len(data) - FOOTER_BYTES:
            raise Corrupt("block out of range")
        return at, at + size

    handles = []
    for _, value in _entries(data[slice(*span(index_at, index_size))]):
        c = Cursor(value)
        handles.append(span(c.number(), c.number()))
        if c:
            raise Corrupt("bytes after a handle")
    spans = [*handles, span(bloom_at, bloom_size), span(index_at, index_size)]
    for (_, b), crc in zip(spans, crc32c_all([data[a:b] for a, b in spans]), strict=True):
        if int.from_bytes(data[b : b + 4], "little") != crc:
            raise Corrupt("block checksum")
    out, before = [], None
    for a, b in handles:
        for k, value in _entries(data[a:b]):
            key, seq, kind = split_key(k)
            place = (key, -seq, -kind)
            if before is not None and place <= before:
                raise Corrupt("out of order")
            before = place
            out.append((key, seq, kind, value if kind == PUT else None))
    return Table(out, data[bloom_at : bloom_at + bloom_size])


class OpenTable:
    """A table file read by parts: the footer and the index first, then the blocks that are asked for, each checked when read."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER_BYTES or int.from_bytes(data[-8:], "little") != TABLE_MAGIC or crc32c_all([data[-FOOTER_BYTES:-12]])[0] != int.from_bytes(data[-12:-8], "little"):
            raise Corrupt("no table")
        self.data = data
        bloom_at, bloom_size, index_at, index_size, version = struct.unpack("<QQQQI", data[-FOOTER_BYTES:-12])
        if version != TABLE_VERSION:
            raise Corrupt(f"version {version}")
        self.bloom = self.block(bloom_at, bloom_size)
        self.lasts: list[bytes] = []
        self.handles: list[tuple[int, int]] = []
        for last, handle in _entries(self.block(index_at, index_size)):
            c = Cursor(handle)
            self.lasts.append(split_key(last)[0])
            self.handles.append((c.number(), c.number()))
        self.held: tuple[int, list[bytes], list[tuple[bytes, int, int, bytes | None]]] = (-1, [], [])

    def block(self, at: int, size: int) -> bytes:
        body = self.data[at : at + size]
        if at + size + 4 > len(self.data) - FOOTER_BYTES or crc32c_all([body])[0] != int.from_bytes(self.data[at + size : at + size + 4], "little"):
            raise Corrupt("block")
        return body

    def from_key(self, start: bytes) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """Entries (key, seq, kind, value) from a key on: blocks that end before it are not read."""
        for i in range(bisect_left(self.lasts, start), len(self.handles)):
            keys, entries = self.entries(i)
            yield from entries[bisect_left(keys, start) :]

    def entries(self, i: int) -> tuple[list[bytes], list[tuple[bytes, int, int, bytes | None]]]:
        """Keys and entries of a block. The one read last is held: keys that are asked for in order read each block once."""
        if self.held[0] != i:
            found = [(*split_key(k), value) for k, value in _entries(self.block(*self.handles[i]))]
            self.held = i, [e[0] for e in found], [(key, seq, kind, value if kind == PUT else None) for key, seq, kind, value in found]
        return self.held[1], self.held[2]

    def newest(self, key: bytes) -> tuple[bytes, int, int, bytes | None] | None:
        """The newest entry of a key, or None; the bloom filter spares most blocks of absent keys."""
        first = next(self.from_key(key), None) if may_contain(self.bloom, key) else None
        return first if first is not None and first[0] == key else None


# -- manifest and shard map


def decode_edit(payload: bytes) -> list[dict]:
    """Rows of one edit: counters set, files added and deleted."""
    c, rows = Cursor(payload), []
    names = {TAG_LOG: "log_number", TAG_NEXT_FILE: "next_file_num", TAG_LAST_SEQ: "last_seq"}

    def level() -> int:
        n = c.number()
        if n >= LEVELS:
            raise Corrupt(f"level {n}")
        return n

    while c:
        tag = c.number()
        if tag in names:
            rows.append({"action": names[tag], "number": c.number()})
        elif tag == TAG_ADD:
            row = {"action": "add", "level": level(), "file_num": c.number(), "size": c.number()}
            rows.append(row | {"smallest": split_key(c.sized())[0], "largest": split_key(c.sized())[0]})
        elif tag == TAG_DELETE:
            rows.append({"action": "delete", "level": level(), "file_num": c.number()})
        else:
            raise Corrupt(f"tag {tag}")
    return rows


def encode_edit(rows: list[dict]) -> bytes:
    """One edit of rows as ``decode_edit`` gives them."""
    tags = {"log_number": TAG_LOG, "next_file_num": TAG_NEXT_FILE, "last_seq": TAG_LAST_SEQ}
    out = b""
    for row in rows:
        action = row["action"]
        if action in tags:
            out += number_bytes(tags[action]) + number_bytes(row["number"])
            continue
        if not 0 <= row["level"] < LEVELS:
            raise ValueError(f"level {row['level']}")
        out += number_bytes(TAG_ADD if action == "add" else TAG_DELETE) + number_bytes(row["level"]) + number_bytes(row["file_num"])
        if action == "add":
            out += number_bytes(row["size"]) + b"".join(sized_bytes(internal_key(row[end], 0, PUT)) for end in ("smallest", "largest"))
    return out


def encode_shard_map(epoch: int, slots: list[tuple[int, bool]]) -> bytes:
    """``slots``: (group, migrating) of each slot."""
    marks = sum(1 << s for s, (_, migrating) in enumerate(slots) if migrating)
    return struct.pack("<Q", epoch) + b"".join(number_bytes(g) for g, _ in slots) + marks.to_bytes(SLOTS // 8, "little")


def decode_shard_map(data: bytes) -> tuple[int, list[tuple[int, bool]]]:
    c = Cursor(data)
    epoch, groups = c.u64(), [c.number() for _ in range(SLOTS)]
    marks = int.from_bytes(c.take(SLOTS // 8), "little")
    if c:
        raise Corrupt("bytes after the map")
    return epoch, [(g, bool(marks >> s & 1)) for s, g in enumerate(groups)]


# -- a replica's state file

# Kinds of records.
STATE_HARD, STATE_ENTRIES, STATE_TRUNCATE, STATE_COMPACT = 1, 2, 3, 4


@dataclass
class ReplicaState:
    """What a state file leaves: term, vote, commit, the snapshot's place, and entries (type, index, term, data) after it."""

    term: int = 0
    vote: int = 0
    commit: int = 0
    snapshot: tuple[int, int] = (0, 0)
    entries: dict[int, tuple[int, int, int, bytes]] = field(default_factory=dict)

    def cut_from(self, index: int) -> None:
        if index <= self.snapshot[0]:
            raise Corrupt(f"index {index} is in the snapshot")
        for i in [i for i in self.entries if i >= index]:
            del self.entries[i]


def replay_state(payloads: list[bytes]) -> ReplicaState:
    """Fold the records of a state file. An entry written again takes the place of itself and all after it; a gap is corruption."""
    state = ReplicaState()
    for payload in payloads:
        c = Cursor(payload)
        tag = c.take(1)[0]
        if tag == STATE_HARD:
            state.term, state.vote, state.commit = c.u64(), c.u64(), c.u64()
        elif tag == STATE_COMPACT:
            if state.entries or state.snapshot[0]:
                raise Corrupt("snapshot mark after entries")
            state.snapshot = c.u64(), c.u64()
        elif tag == STATE_TRUNCATE:
            state.cut_from(c.u64())
        elif tag == STATE_ENTRIES:
            for _ in range(int.from_bytes(c.take(4), "little")):
                kind, index, term = c.take(1)[0], c.u64(), c.u64()
                data = c.take(int.from_bytes(c.take(4), "little"))
                state.cut_from(index)
                if index != state.snapshot[0] + len(state.entries) + 1:
                    raise Corrupt(f"gap before index {index}")
                state.entries[index] = (kind, index, term, data)
        else:
            raise Corrupt(f"record {tag}")
        if c:
            raise Corrupt("bytes after a record")
    return state


def encode_entries(entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """A state record of entries (type, index, term, data)."""
    body = b"".join(struct.pack("<BQQI", kind, index, term, len(data)) + data for kind, index, term, data in entries)
    return bytes([STATE_ENTRIES]) + struct.pack("<I", len(entries)) + body


# -- Spark

_OPS = "seq bigint, key binary, kind tinyint, value binary"


def _op_batches(rows: Iterator[tuple[int, bytes, int, bytes | None]], extra: list[tuple[str, object, pa.DataType]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int8(), pa.binary())
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        more = [pa.array([v] * len(held), t) for _, v, t in extra]
        return pa.RecordBatch.from_arrays([*more, *columns], names=[*(n for n, _, _ in extra), "seq", "key", "kind", "value"])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """segment, bytes, clean_bytes of each log segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers = [int(re.search(SEGMENT_NAME, path)[1]), len(content), unframe(content)[1]]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in numbers], names=["segment", "bytes", "clean_bytes"])

    return _files(spark, folder, "*.wal").mapInArrow(run, "segment bigint, bytes bigint, clean_bytes bigint")


def segment_faults(found: DataFrame, newest: int | None = None) -> DataFrame:
    """Segments that are torn though a later one exists, or that follow a gap: segment, fault. ``newest``: the last one there is, if not in ``found``."""
    w = Window.orderBy("segment")  # a row for each file of a log
    seen = found.withColumn("before", F.lag("segment").over(w)).withColumn("last", F.lit(newest) if newest is not None else F.max("segment").over(Window.partitionBy()))
    fault = F.when(F.col("segment") != F.col("before") + 1, "missing segment before").when((F.col("clean_bytes") < F.col("bytes")) & (F.col("segment") < F.col("last")), "corrupt")
    return seen.select("segment", fault.alias("fault")).where("fault is not null")


def segment_numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the segments by the folder's listing: Spark's own reader passes over empty files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.wal")
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(m[1]) for f in listed if (m := re.search(SEGMENT_NAME, f.getPath().getName())))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The ops of a log folder. A torn end of the newest segment is dropped; any other damage is an error."""
    numbers = segment_numbers(spark, folder)
    if not numbers:
        return spark.createDataFrame([], _OPS)
    faults = [f"segment {b:06d}: missing segment before" for a, b in zip(numbers, numbers[1:], strict=False) if b != a + 1]
    faults += [f"segment {r.segment:06d}: {r.fault}" for r in segment_faults(segments(spark, folder), numbers[-1]).where("fault = 'corrupt'").limit(5).collect()]
    if faults:
        raise Corrupt("; ".join(faults[:5]))
    return ops_of_segments(_files(spark, folder, "*.wal").select("content"))


def ops_of_segments(files: DataFrame) -> DataFrame:
    """The ops of the clean start of each segment (content)."""

    def ops(content: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        for a, b in spans:
            base, found = decode_batch(content[a + 8 : b])
            for i, (kind, key, value) in enumerate(found):
                yield base + i, key, kind, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                body = content.as_py()
                if spans := _records(body):
                    made = decode_batches(body, spans)
                    yield from _op_batches(ops(body, spans), []) if made is None else [made]

    return files.select("content").mapInArrow(run, _OPS)


def packed_batches(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, ops, and base_seq if they are numbered) with their ops encoded: n_ops and body instead of ops. Those without ops are left out."""
    own = ["batch_id", *(["base_seq"] if "base_seq" in batches.columns else [])]

    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > 1 << 28:
            half = batch.num_rows // 2
            yield from packed(batch.slice(0, half))
            yield from packed(batch.slice(half))
        else:
            ops = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.list_value_length(ops).cast(pa.int64()), encode_ops(ops)], names=[*own, "n_ops", "body"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(batch.num_columns - 1)), 0), False))
            if batch.num_rows:
                yield from packed(batch)

    return batches.select(*own, "ops").mapInArrow(run, ", ".join(f"{c} bigint" for c in own) + ", n_ops bigint, body binary")


def log_segments(batches: DataFrame, segment_bytes: int) -> DataFrame:
    """Log files of batches (batch_id, ops; base_seq too, or they are numbered from 1): segment from 1, batches, first_seq, last_seq, content, newest.

    The log is cut where its bytes pass a multiple of ``segment_bytes``, so a segment holds about that many,
    or one larger batch. Batches without ops are not written.

    The encoded batches are written once to the shared folder: their sizes, which say where the log is cut,
    are then read by themselves.
    """

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by("base_seq")
        base, n_ops = (np.asarray(rows.column(c).combine_chunks()) for c in ("base_seq", "n_ops"))
        content = frame_batches(base, rows.column("body").combine_chunks())
        made = [rows.column("segment")[0].as_py(), len(base), int(base[0]), int(base[-1] + n_ops[-1] - 1), content, rows.column("newest")[0].as_py()]
        return pa.table([pa.array([v], t) for v, t in zip(made, (*[pa.int64()] * 4, pa.binary(), pa.bool_()), strict=True)], names=["segment", "batches", "first_seq", "last_seq", "content", "newest"])

    spark = batches.sparkSession
    path = scratch(spark)
    packed_batches(batches).withColumn("_size", F.octet_length("body") + 16).write.parquet(path)
    held = spark.read.parquet(path)
    amounts = {"_size": "_passed"} | ({} if "base_seq" in held.columns else {"n_ops": "_taken"})
    placed = running_totals(held, "batch_id", amounts).withColumn("_cut", F.expr(f"_passed div {segment_bytes}"))
    if "base_seq" not in held.columns:
        placed = placed.withColumn("base_seq", F.col("_taken") + 1)
    nth = F.row_number().over(Window.orderBy("_cut")).cast("long")
    cuts = placed.select("_cut").distinct().select(F.col("_cut").alias("_of"), nth.alias("segment"), (F.lead("_cut").over(Window.orderBy("_cut")).isNull()).alias("newest"))  # a row for each file
    dealt = placed.join(cuts, F.col("_cut") == F.col("_of")).select("segment", "newest", "base_seq", "n_ops", "body")
    return dealt.groupBy("segment").applyInArrow(build, "segment bigint, batches bigint, first_seq bigint, last_seq bigint, content binary, newest boolean")


def after_prune(segments: DataFrame, below: int) -> DataFrame:
    """The segments left when those numbered below ``below`` are removed; the newest one never is."""
    newest = segments.agg(F.max("segment").alias("_newest"))
    return segments.join(F.broadcast(newest), (F.col("segment") >= below) | (F.col("segment") == F.col("_newest"))).drop("_newest")


def read_tables(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """The ops of table files: file, seq, key, kind, value."""
    return ops_of_tables(_files(spark, path, pattern))


def ops_of_tables(files: DataFrame) -> DataFrame:
    """The ops of table files (path, content): file, seq, key, kind, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    entries = parse_table(content).entries
                except Corrupt as e:
                    raise Corrupt(f"{name}: {e}") from e
                yield from _op_batches(((seq, key, kind, value) for key, seq, kind, value in entries), [("file", name, pa.string())])

    return files.select("path", "content").mapInArrow(run, f"file string, {_OPS}")


def seek_tables(files: DataFrame, start: bytes) -> DataFrame:
    """The ops from a key on of table files (path, content); blocks before it are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _op_batches(((seq, key, kind, value) for key, seq, kind, value in OpenTable(content).from_key(start)), [("file", name, pa.string())])

    return files.select("path", "content").mapInArrow(run, f"file string, {_OPS}")


#: Neighbouring wanted keys that a file is asked for together.
LOOK_UP_BLOCK = 4096


def look_up(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest version that each table file (path, content) has of the keys ``wanted``: file, seq, key, kind, value.

    Each file gets the keys within its own bounds, once; bloom filters and indexes spare it most blocks.
    Wanted keys and files' ends are dealt in one order and numbered; a file's keys are then a run of
    numbers and meet it by blocks of them: an equi-join, whatever the files.
    """
    bounds = files.select("path", "content").mapInArrow(_bounds, "path string, smallest binary, largest binary").where("smallest is not null")
    ends = bounds.select("path", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("smallest").alias("key")), F.struct(F.lit(2).alias("side"), F.col("largest").alias("key")))).alias("end"))
    both = wanted.select("key").where("key is not null").distinct().withColumn("side", F.lit(1)).unionByName(ends.select("path", "end.side", "end.key"), allowMissingColumns=True)
    dealt = cut(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col("_part").alias("_of")).agg(F.count_if(F.col("side") == 1).alias("_n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_of", F.coalesce(F.sum("_n").over(before.orderBy("_of")), F.lit(0)).alias("_before"))  # a row for each partition
    within = F.coalesce(F.sum((F.col("side") == 1).cast("long")).over(before.partitionBy("_part").orderBy("key", "side")), F.lit(0))
    at = dealt.withColumn("_within", within).join(counts, F.col("_part") == F.col("_of")).withColumn("at", F.col("_before") + F.col("_within"))
    keys = at.where("side = 1").select(F.expr(f"at div {LOOK_UP_BLOCK}").alias("block"), "at", "key")
    spans = at.where("side <> 1").groupBy("path").agg(F.min("at").alias("first"), F.max("at").alias("end")).where("first < end")
    runs = spans.select("path", "first", "end", F.explode(F.expr(f"sequence(first div {LOOK_UP_BLOCK}, (end - 1) div {LOOK_UP_BLOCK})")).alias("block"))
    inside = runs.join(keys, "block").where("at >= first and at < end").select("path", "block", "key")
    asked = files.select("path", "content").join(runs.select("path", F.col("block").alias("run")), "path")

    def find(keys: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        for path, content in zip(held.column("path").to_pylist(), held.column("content").to_pylist(), strict=True):
            table = OpenTable(content)
            found += [(path, *hit) for key in sorted(keys.column("key").to_pylist()) if (hit := table.newest(key))]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int8(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "key", "seq", "kind", "value"])

    out = inside.groupBy("path", "block").cogroup(asked.groupBy("path", "run")).applyInArrow(find, "file string, key binary, seq bigint, kind tinyint, value binary")
    return out.select("file", "seq", "key", "kind", "value")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, first, last = batch.column(0).to_pylist(), [], []
        for content in batch.column(1).to_pylist():
            table = OpenTable(content)
            first.append(next(table.from_key(b""), (None,))[0])
            last.append(table.lasts[-1] if table.lasts else None)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(first, pa.binary()), pa.array(last, pa.binary())], names=["path", "smallest", "largest"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Edits of a manifest file: edit_id, action, level, file_num, size, smallest, largest, number (a counter's value)."""
    return edits_of(spark.read.format("binaryFile").load(path).select("content"))


def edits_of(files: DataFrame) -> DataFrame:
    """Edits of manifest files (content)."""
    schema = "edit_id bigint, action string, level int, file_num bigint, size bigint, smallest binary, largest binary, number bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [row | {"edit_id": i} for i, payload in enumerate(unframe(content)[0]) for row in decode_edit(payload)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(run, schema)


def manifest_file(edits: DataFrame) -> DataFrame:
    """A manifest (content) of edits (edit_id, action, level, file_num, size, smallest, largest, and number if there are counters), a record for each edit_id.

    One file for a store: a row for each stored file and change, so one task writes it.
    """

    def build(group: pa.Table) -> pa.Table:
        records: dict[int, list[dict]] = {}
        for row in group.sort_by([("edit_id", "ascending"), ("action", "descending"), ("file_num", "ascending")]).to_pylist():
            records.setdefault(row["edit_id"], []).append(row)
        return pa.table({"content": pa.array([frames([encode_edit(rows) for rows in records.values()])], pa.binary())})

    return edits.groupBy(F.lit(0).alias("of")).applyInArrow(build, "content binary")


def rotated_manifest(live: DataFrame, counters: dict[str, int]) -> DataFrame:
    """A fresh manifest (content) that says in one edit what a version is: its files and counters."""
    spark = live.sparkSession
    rows = live.select(F.lit(0).cast("long").alias("edit_id"), F.lit("add").alias("action"), "level", "file_num", "size", "smallest", "largest")
    numbers = spark.createDataFrame([(0, name, value) for name, value in counters.items()], "edit_id long, action string, number long")
    return manifest_file(rows.unionByName(numbers, allowMissingColumns=True))


def map_files(maps: DataFrame) -> DataFrame:
    """Encoded shard maps (content), one for each epoch: 256 rows each."""

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by("slot").to_pylist()
        return pa.table({"content": pa.array([encode_shard_map(rows[0]["epoch"], [(r["group_id"], r["migrating"]) for r in rows])], pa.binary())})

    return maps.groupBy("epoch").applyInArrow(build, "content binary")


def maps_of(files: DataFrame) -> DataFrame:
    """Shard maps of their files (content): epoch, slot, group_id, migrating."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                epoch, slots = decode_shard_map(content)
                columns = ([epoch] * SLOTS, list(range(SLOTS)), [g for g, _ in slots], [m for _, m in slots])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["epoch", "slot", "group_id", "migrating"])

    return files.select("content").mapInArrow(run, "epoch bigint, slot int, group_id bigint, migrating boolean")


def entries_of_commands(commands: DataFrame) -> DataFrame:
    """Commands (log_index, term, entry_type, client_id, client_seq, ops) as log entries with their encoded data; one without ops has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            data = [b"" if r["ops"] is None else encode_command(r["client_id"], r["client_seq"], [(o["kind"], o["key"], o["value"]) for o in r["ops"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["log_index", "term", "entry_type", "data"])

    return commands.select("log_index", "term", "entry_type", "client_id", "client_seq", "ops").mapInArrow(run, "log_index bigint, term bigint, entry_type tinyint, data binary")


def bloom_hashes(rows: DataFrame) -> DataFrame:
    """``key`` and its ``bloom_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bloom_hash(k) for k in batch.column(0).to_pylist()], pa.int64())], names=["key", "bloom_hash"])

    return rows.select("key").mapInArrow(run, "key binary, bloom_hash bigint")


def read_replicas(spark: SparkSession, path: str) -> DataFrame:
    """The surviving entries of replicas' state files: file, log_index, term, entry_type, data. A torn end is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(replay_state(unframe(content)[0]).entries.values())
                columns = ([name] * len(found), [e[1] for e in found], [e[2] for e in found], [e[0] for e in found], [e[3] for e in found])
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "log_index", "term", "entry_type", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, log_index bigint, term bigint, entry_type tinyint, data binary")


def commands_of(entries: DataFrame) -> DataFrame:
    """Committed entries (log_index, term, entry_type, data) as commands; entries of type 0 without data have no ops, like changes of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        op = pa.list_(pa.struct([("kind", pa.int8()), ("key", pa.binary()), ("value", pa.binary())]))
        for batch in batches:
            rows = [decode_command(d) if k == 0 and d else (None, None, None) for k, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ops = [None if o is None else [{"kind": k, "key": key, "value": v} for k, key, v in o] for _, _, o in rows]
            made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ops, op)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["log_index", "term", "entry_type", "client_id", "client_seq", "ops"])

    schema = "log_index bigint, term bigint, entry_type tinyint, client_id bigint, client_seq bigint, ops array<struct<kind:tinyint,key:binary,value:binary>>"
    return entries.select("log_index", "term", F.col("entry_type").cast("tinyint"), "data").mapInArrow(run, schema)


def table_files(outputs: DataFrame) -> DataFrame:
    """Table files of compaction outputs (part, file_no and ops): part, file_no, content. Each output is a few MB by construction."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("key", "seq", "kind", "value")), strict=True), key=lambda r: (r[0], -r[1]))
        return pa.table({"part": group.column("part").slice(0, 1), "file_no": group.column("file_no").slice(0, 1), "content": pa.array([build_table(rows)], pa.binary())})

    kind = outputs.schema["part"].dataType.simpleString()
    return outputs.select("part", "file_no", "key", "seq", "kind", "value").groupBy("part", "file_no").applyInArrow(run, f"part {kind}, file_no bigint, content binary")

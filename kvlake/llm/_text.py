"""Vectorised word hashing over Arrow string buffers.

Texts of a slice lie one after another in one byte buffer, so words are found and hashed with a
few NumPy passes over the bytes instead of a Python step for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass handles; temporary arrays take about 40 times this.
BLOCK = 1 << 18


def byte_set(values: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = byte_set(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but letters and digits.
NOT_ALNUM = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))

SAME = np.arange(256, dtype=np.uint8)
FOLD = SAME.copy()
FOLD[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, limit: int = 8 * BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, each of about ``limit`` bytes; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _blocks(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the bytes where no word crosses."""
    start, n = 0, data.size
    while start < n:
        end = min(start + BLOCK, n)
        if end < n:
            gaps = np.flatnonzero(separators[data[start:end]])
            if gaps.size:
                end = start + int(gaps[-1]) + 1
            else:
                after = np.flatnonzero(separators[data[end:]])
                text_end = int(offsets[np.searchsorted(offsets, end)])
                end = min(end + int(after[0]) if after.size else n, text_end)
        yield start, end
        start = end


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = SAME, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hash, first byte and end byte of every word, and for each text the index of its first word.

    For each length in ``stems``, one more array holds the hash of each word's first bytes, so many.
    """
    inner = offsets[1:-1]
    hashes, starts, ends, cut = [], [], [], [[] for _ in stems]
    byte = _BYTE[fold]
    for a, b in _blocks(data, offsets, separators):
        part = data[a:b]
        word = ~separators[part]
        edge = np.zeros(b - a + 1, dtype=bool)
        edge[inner[np.searchsorted(inner, a) : np.searchsorted(inner, b, side="right")] - a] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        closes = word.copy()
        closes[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        up, down = (_UP, _DOWN) if b - a <= BLOCK else (_powers(_BASE, b - a + 1), _powers(_INVERSE, b - a + 1))
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(byte[part] * up[: b - a], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        for parts, size in zip(cut, stems, strict=True):
            parts.append(mix((sums[np.minimum(e, s + size)] - sums[s]) * down[s] + np.uint64(size)))
        starts.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else none
    e = np.concatenate(ends) if ends else none
    return h, s, e, np.searchsorted(s, offsets), *(np.concatenate(parts) if parts else np.zeros(0, np.uint64) for parts in cut)


def per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``marks`` (one for each byte or word) are set within each text."""
    return np.array([np.count_nonzero(marks[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], dtype=np.int64)

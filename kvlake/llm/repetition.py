"""Quality rules with suffix-array repetition.

The words of a run of texts get one suffix array, built by prefix doubling on whole arrays; the first
ranks depend on the text, so suffixes of different texts never tie. Neighbours' longest common
prefixes give, for each word, the longest passage that starts there and stands elsewhere in its text:
the LCP intervals that are maximal to the right. Their spans are united; a text is refused if they
cover too large a share of it or if one of them is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

_SYMBOL = _text.byte_set(b"#*$%&|<>")
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """``min_repeat``: words from which on a repeated passage counts; ``max_covered``: their share of the words; ``max_longest``: words of the longest.

    The last two lie well below what ``max_window_percent`` lets pass, so that each can refuse a row of its own.
    """

    min_words: int = 10
    max_window_percent: int = 20
    min_repeat: int = 10
    max_covered: float = 0.1
    max_longest: int = 50


def suffix_array(word: np.ndarray, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and ranks by the first 1, 2, 4, ... words; ``end``: where the text of each word ends."""
    n = word.size
    _, first, group, counts = np.unique(_text.mix(word + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    begins = np.cumsum(counts) - counts
    rank = begins[group]
    levels, width = [rank.astype(np.int32)], 1
    tied = np.flatnonzero(counts[group] > 1)
    while tied.size:
        after = tied + width
        second = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = rank[tied]
        new_key = np.append(True, key[1:] != key[:-1])
        new_old = np.append(True, old[1:] != old[:-1])
        at = np.arange(tied.size)
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        first_of_old = np.maximum.accumulate(np.where(new_old, at, 0))
        rank = rank.copy()
        rank[tied] = old + first_of_key - first_of_old
        levels.append(rank.astype(np.int32))
        alone = new_key & np.append(new_key[1:], True)
        tied = tied[~alone]
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on stand at another place of its text as well."""
    n = word.size
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(sizes.size), sizes)
    end = np.repeat(bounds[1:], sizes)
    order, levels = suffix_array(word, owner, end)
    a, b = order[:-1], order[1:]
    some = levels[0][a] == levels[0][b]
    a, b = a[some], b[some]
    lcp = np.zeros(a.size, dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < end[a]) & (j < end[b])
        equal = inside & (levels[t][np.minimum(i, n - 1)] == levels[t][np.minimum(j, n - 1)])
        lcp += equal.astype(np.int64) << t
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    h, starts, ends, bounds = _text.words(data, offsets)
    size = np.diff(bounds)
    point = ((data & 0xC0) != 0x80) & ~_text.SPACE[data]
    reach = longest_repeats(h, bounds)
    window = np.flatnonzero(reach >= WINDOW)
    passage = np.flatnonzero(reach >= min_repeat)
    longest = np.zeros(size.size, dtype=np.int64)
    if h.size:
        some = size > 0
        longest[some] = np.maximum.reduceat(reach, bounds[:-1][some])
    return {
        "n_words": size,
        "word_chars": _text.per_text(point, offsets),
        "n_symbols": _text.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([_repeated_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64),
        "n_repeat_words": _text.per_text(united(window, np.full(window.size, WINDOW), h.size), bounds),
        "covered_words": _text.per_text(united(passage, reach[passage], h.size), bounds),
        "longest_repeat": longest,
    }


def _rows(min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch.column(1)):
                found = measure(data, offsets, min_repeat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(v.astype(np.int64)) for v in found.values())], names=["doc_id", *found])

    return run


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The counts and the verdict of each row of ``docs`` (doc_id, text); one pass, no shuffle.

    A null or empty text has no word, fails the base rules and is not kept. Repeated rows and null
    ids are judged like any other; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
    rows = docs.select("doc_id", "text").mapInArrow(_rows(limits.min_repeat), f"doc_id {kind}, {counts}")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_window_percent * F.col("n_words"))
    fits = (F.col("covered_words") <= limits.max_covered * F.col("n_words")) & (F.col("longest_repeat") <= limits.max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)

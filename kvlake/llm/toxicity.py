"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct buckets of words, of words cut to stems (their first bytes, for inflected
forms), of the second, third and fourth time that a stem comes up in a text, of pairs of neighbours and
of pairs one word apart.
Per-coordinate learning rates and L1 leave few weights that are not zero; those alone are sent to
the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import give_back, tidy


#: Bytes of the stems, and how many times of one in a text are told apart.
STEMS, TIMES = (5, 7), 4


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows that may be learned from, at most (those first by a hash of their id)."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 5
    sample: int = 20_000
    threshold: float = 0.7


def _again(stems: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features, and their texts, of the second to ``TIMES``-th time that a stem comes up in a text."""
    key = _text.mix(stems + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.arange(key.size)
    nth = at - np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: key.size], at, 0))
    places = [order[nth == n] for n in range(1, TIMES)]
    return [_text.mix(stems[p] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) for n, p in enumerate(places, 1)], [owner[p] for p in places]


def grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of a slice, and the text it is in; a text's buckets may repeat."""
    h, _, _, bounds, *stems = _text.words(data, offsets, _text.NOT_ALNUM, _text.FOLD, STEMS)
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(bounds))
    found, owners = [h, *stems], [owner] * (1 + len(stems))
    for one in stems:
        more, of = _again(one, owner)
        found += more
        owners += of
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0876A9A4B)):
        same = owner[gap:] == owner[:-gap]
        found.append(_text.mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        owners.append(owner[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one text after another, and where each text's begin."""
    bucket, owner = grams(data, offsets, bits)
    key = np.unique(owner << bits | bucket)
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(offsets.size) << bits)


#: Gaps are held in 16 bits: this many or more is this number, again and again, and the rest.
GAP = 65535


def packed(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending buckets of each text as gaps of 16 bits, and where each text's begin: half of their bytes."""
    gaps = np.diff(ids, prepend=0).astype(np.int64)
    heads = bounds[:-1][np.diff(bounds) > 0]
    gaps[heads] = ids[heads]
    ends = np.cumsum(gaps // GAP + 1)
    out = np.full(int(ends[-1]) if ends.size else 0, GAP, dtype=np.uint16)
    out[ends - 1] = gaps % GAP
    return out, np.append(0, ends)[bounds]


def unpacked(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != GAP]


class Examples:
    """Packed (buckets, label) rows that are unpacked one by one, each time they are gone through."""

    def __init__(self, rows: list[tuple[np.ndarray, int]]):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        return ((unpacked(gaps), label) for gaps, label in self.rows)


def learn(rows: Iterable[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (buckets, label) rows in the given order: bucket ids, their weights, the bias."""
    size = 1 << s.bits
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        l1 = np.where(at == size, 0.0, s.l1)  # the bias is not held back
        w = -(zz - np.sign(zz) * l1) / ((s.beta + np.sqrt(g2[at])) / s.alpha + s.l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(s.epochs):
        for buckets, label in rows:
            at = np.append(buckets, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / s.alpha * w
            g2[at] += g * g
    ids = np.flatnonzero(np.abs(z[:-1]) > s.l1)  # the others weigh nothing
    w = weights(ids)
    return ids[w != 0].astype(np.int32), w[w != 0], float(weights(np.array([size]))[0])


def _bucket_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch.column(2)):
                gaps, bounds = packed(*features(data, offsets, bits))
                held = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(gaps)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), held], names=["at", "label", "gaps"])

    return run


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from labelled rows; ``labels`` (doc_id, toxic) holds those that may be seen.

    At most ``s.sample`` rows are taken, so both the broadcast ids and the rows that reach the
    driver are bounded; a row sends two bytes for each of its distinct features. Null ids or labels
    are passed over, repeated labels count once, and an id with both labels counts with each. Without
    any row the model is a bias of 0.
    """
    at = F.xxhash64("doc_id")
    seen = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"), at.alias("at")).distinct()
    few = seen.orderBy("at", "doc_id", "label").limit(s.sample).withColumnRenamed("doc_id", "l_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("l_id")).select("at", "label", "text")
    got = rows.mapInArrow(tidy(_bucket_rows(s.bits)), "at long, label int, gaps binary").toArrow()
    examples = []  # views of the batches as they came: nothing is copied
    for batch in got.to_batches():
        at, label, gaps = batch.columns
        examples += [(k, y, np.frombuffer(x.as_buffer(), np.uint16)) for k, y, x in zip(at.to_pylist(), label.to_pylist(), gaps, strict=True)]
        del batch, at, label, gaps
    examples.sort(key=lambda e: e[:2])
    model = learn(Examples([(gaps, y) for _, y, gaps in examples]), s)
    del got, examples
    give_back()
    return model


def _score_rows(model: tuple[np.ndarray, np.ndarray, float], bits: int):
    ids, w, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.float64)
        table[ids] = w
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in _text.slices(batch.column(batch.num_columns - 1)):
                bucket, owner = grams(data, offsets, bits)
                heavy = table[bucket] != 0  # a few in a text: only these need be made distinct
                key = np.unique(owner[heavy] << bits | bucket[heavy])
                total = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], b - a)
                out[a:b] = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings = Settings()) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``; null and empty texts get the bias alone.

    Rows that repeat, or have no id, are scored like any other; an empty table gives no rows; other
    columns of ``docs`` are not read. A long text is scored as a whole, in one pass over its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_score_rows(model, s.bits)), f"doc_id {kind}, score double")


def _flag_rows(model: tuple[np.ndarray, np.ndarray, float], s: Settings, text_at: int):
    scored = _score_rows(model, s.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(text_at)], names=["text"])
            marks = next(scored(iter([one]))).column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(marks < s.threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that score ``s.threshold`` or more; one pass, the columns stay as they are, whatever their names.

    Repeated rows and rows without an id are judged like any other; an empty table gives no rows.
    """
    model = train(docs, labels, s)
    return docs.mapInArrow(tidy(_flag_rows(model, s, docs.columns.index("text"))), docs.schema)

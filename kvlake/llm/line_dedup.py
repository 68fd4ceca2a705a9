"""Line dedup by a deletion-neighbourhood join.

A line is the sequence of its words; lines within one word edit (a word put in, left out or replaced)
of an earlier line go, and so do equal ones. The neighbourhood of a line is the line itself and the
line without each of its words: two lines are within one edit only if they have a variant in common,
as whole line against deletion or as deletions at the same place. Variants are hashed from prefix
sums, all of a line in one pass. Buckets of equal variants are not expanded: each member meets the
bucket's earliest line, and the edit distance of that pair is verified on the words.

Before variants are made, lines that can't have a partner are set aside without loss: one edit
leaves the first or the last half of a line as it was, so a line none of whose halves occurs in
another line has no neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import cut

#: One edit leaves lines of so many words alike by 0.8 or more; shorter ones have equal copies only.
MIN_WORDS = 5
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Sums:
    """Hashes of any run of words of a slice, from prefix sums."""

    def __init__(self, h: np.ndarray, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.down = _text._powers(self.inverse, h.size + 2)
        self.sums = np.zeros(h.size + 1, dtype=np.uint64)
        np.cumsum(h * _text._powers(base, h.size + 1)[: h.size], out=self.sums[1:])

    def run(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _text.mix((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64))

    def without(self, first: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The run without the word at ``gap``: what follows moves up by one."""
        left, right = self.sums[gap] - self.sums[first], (self.sums[end] - self.sums[gap + 1]) * np.uint64(self.inverse)
        return _text.mix((left + right) * self.down[first] + (end - first - 1).astype(np.uint64))


def _line_bounds(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: its text, its number in the text, its first and end word; and each text's count of lines."""
    breaks = np.flatnonzero(data == 10)
    before_text = np.searchsorted(breaks, offsets)
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(bounds))
    number = np.searchsorted(breaks, starts) - before_text[owner]
    new = np.ones(starts.size, dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], starts.size)
    return owner[first], number[first], first, end, np.diff(before_text) + 1


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each slice of (doc_id, text): the batch, its rows, sums, and the lines with a word."""
    for batch in batches:
        for a, b, data, offsets in _text.slices(batch.column(1)):
            h, starts, _, bounds = _text.words(data, offsets)
            yield batch, a, b, h, _line_bounds(data, offsets, starts, bounds)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word (``again``: its text has had it before), and one of number -1 for each text, whose n is its count of lines."""
    for batch, a, b, h, (owner, number, first, end, lines) in _described(batches):
        texts = b - a
        fp1, fp2 = (_Sums(h, base).run(first, end).view(np.int64) for base in _BASES)
        again = np.ones(first.size, dtype=bool)
        again[np.unique(_text.mix(fp1.view(np.uint64) + owner.astype(np.uint64)) ^ fp2.view(np.uint64), return_index=True)[1]] = False
        none = np.zeros(texts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.concatenate((owner, np.arange(texts))) + a)),
                pa.array(np.concatenate((number, none - 1)).astype(np.int32)),
                pa.array(np.concatenate((end - first, lines)).astype(np.int32)),
                pa.array(np.concatenate((again, none > 0))),
                pa.array(np.concatenate((fp1, none))),
                pa.array(np.concatenate((fp2, none))),
            ],
            names=["doc_id", "line_no", "n", "again", "fp1", "fp2"],
        )


def _halves(min_words: int):
    """mapInArrow body: (half, fp1) of the lines with ``min_words`` words or more.

    A line of n words is compared with lines of n words by halves of n // 2, and with lines of n - 1
    words by halves of (n - 1) // 2; for an odd n these are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, h, (_, _, first, end, _) in _described(batches):
            sums = _Sums(h, _BASES[0])
            long = end - first >= min_words
            first, end = first[long], end[long]
            fp = sums.run(first, end)
            pairs = []
            for size, some in (((end - first) // 2, np.ones(first.size, bool)), ((end - first - 1) // 2, (end - first) % 2 == 0)):
                f, e, n = first[some], end[some], size[some]
                for side, key in ((1, sums.run(f, f + n)), (2, sums.run(e - n, e))):
                    pairs.append(np.stack((_text.mix(key ^ np.uint64(side)), fp[some])))
            both = np.concatenate(pairs, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["half", "fp1"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, line) to its neighbourhood: the whole line (gap -1) and the line without each word."""
    for batch in batches:
        for a, b, data, offsets in _text.slices(batch.column(1)):
            h, _, _, bounds = _text.words(data, offsets)
            first, end = bounds[:-1], bounds[1:]
            sums = _Sums(h, _BASES[0])
            owner = np.repeat(np.arange(b - a), end - first)
            gap = np.arange(h.size)
            variant = np.concatenate((sums.run(first, end), sums.without(first[owner], end[owner], gap)))
            at = pa.array(np.concatenate((np.arange(b - a), owner)) + a)
            gaps = np.concatenate((np.full(b - a, -1), gap - first[owner]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(gaps.astype(np.int32)), pa.array(variant.view(np.int64))], names=["ord", "gap", "variant"])


def within_one_edit(x: list[str], y: list[str]) -> bool:
    if abs(len(x) - len(y)) > 1:
        return False
    short, long = sorted((x, y), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i:] == long[i + 1 :] or short[i + 1 :] == long[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = lambda column: (line.strip(" \t\n\x0b\x0c\r").translate(_ONE_SPACE).split(" ") for line in column.to_pylist())
        near = [within_one_edit([w for w in x if w], [w for w in y if w]) for x, y in zip(split(batch.column(2)), split(batch.column(3)), strict=True)]
        yield batch.select(["ord", "earlier"]).filter(pa.array(near, pa.bool_()))


_ONE_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _near_lines(named: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """(doc, line, near_doc, near_line) of first lines and the earliest line within one edit of each."""
    halves = named.mapInArrow(_halves(min_words), "half long, fp1 long")
    shared = halves.groupBy("half").agg(F.min("fp1").alias("a"), F.max("fp1").alias("b")).where("a <> b").select("half")
    few = halves.join(shared, "half", "left_semi").select("fp1").distinct()
    wanted = firsts.where(F.col("n") >= min_words).join(few, "fp1", "left_semi").groupBy("doc").agg(F.collect_set("line").alias("wanted"))
    held = named.join(wanted, F.col("doc_id") == F.col("doc"))
    texts = held.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "words"), "wanted").where(F.array_contains("wanted", F.col("line"))).drop("wanted")
    # Numbers in the order of (doc, line), so that the earliest of a bucket is a minimum of numbers.
    texts = cut(texts.repartitionByRange("doc", "line").sortWithinPartitions("doc", "line").withColumn("ord", F.monotonically_increasing_id()))

    made = texts.select("ord", "words").mapInArrow(_variants, "ord long, gap int, variant long")
    met = made.groupBy("variant").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a <> b").select("variant")
    entries = cut(made.join(met, "variant", "left_semi").select("variant", "gap", "ord"))
    alike = entries.where("gap >= 0").groupBy("variant", "gap").agg(F.min("ord").alias("earlier"), F.count(F.lit(1)).alias("m")).where("m > 1")
    replaced = entries.join(alike, ["variant", "gap"]).where("ord > earlier").select("ord", "earlier")
    sides = entries.groupBy("variant").agg(F.min(F.when(F.col("gap") < 0, F.col("ord"))).alias("whole"), F.min(F.when(F.col("gap") >= 0, F.col("ord"))).alias("short"))
    other = F.when(F.col("gap") < 0, F.col("short")).otherwise(F.col("whole"))
    shifted = entries.join(sides.where("whole is not null and short is not null"), "variant").select("ord", other.alias("earlier")).where("ord > earlier")
    pairs = replaced.unionByName(shifted).distinct()
    lines = texts.select("ord", "words")
    both = pairs.join(lines, "ord").join(lines.select(F.col("ord").alias("earlier"), F.col("words").alias("other")), "earlier")
    near = both.select("ord", "earlier", "words", "other").mapInArrow(_verify, "ord long, earlier long").groupBy("ord").agg(F.min("earlier").alias("earlier"))
    places = texts.select("ord", "doc", "line")
    return near.join(places, "ord").join(places.select(F.col("ord").alias("earlier"), F.col("doc").alias("near_doc"), F.col("line").alias("near_line")), "earlier").select("doc", "line", "near_doc", "near_line")


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line_no, n (words), dropped, keep_doc_id and keep_line_no (the earlier line, or itself) of every line with a word,
    and a row with line_no -1 and n the count of lines for every text.

    The earlier line is the earliest that is equal or within one edit. It may go itself, for a still earlier one
    that is within one edit of it but not of this line: dropping looks at pairs, not at chains of them.

    Lines are ordered by doc_id and line number. A null or empty text has one line without a word,
    and such lines stay. Texts without a doc_id take no part and have no rows; a doc_id names one
    text, and rows that repeat it and its text count as one. Other columns of ``docs`` are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(named.mapInArrow(_lines, f"doc_id {kind}, line_no int, n int, again boolean, fp1 long, fp2 long"))
    lines = rows.where("line_no >= 0")
    firsts = lines.where("not again").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc"), F.min_by("line_no", "doc_id").alias("line"), F.max("n").alias("n"))
    near = _near_lines(named, firsts, min_words)
    kept = firsts.drop("n").join(near, ["doc", "line"], "left")
    told = lines.drop("again").join(kept, ["fp1", "fp2"])
    keep_doc, keep_line = F.coalesce("near_doc", "doc"), F.coalesce("near_line", "line")
    told = told.select("doc_id", "line_no", "n", ((F.col("doc_id") != keep_doc) | (F.col("line_no") != keep_line)).alias("dropped"), keep_doc.alias("keep_doc_id"), keep_line.alias("keep_line_no"))
    heads = rows.where("line_no < 0").select("doc_id", "line_no", "n", F.lit(False).alias("dropped"), F.lit(None).cast(kind).alias("keep_doc_id"), F.lit(None).cast("int").alias("keep_line_no"))
    return told.unionByName(heads)


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (sorted line numbers), kept_from (doc_id of each dropped line's earlier line) of each text."""
    told = line_verdicts(docs, min_words)
    gone = told.where("dropped").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "keep_doc_id"))).alias("gone"))
    heads = told.where("line_no < 0").groupBy("doc_id").agg(F.max("n").cast("long").alias("n_lines"))
    met = heads.join(gone, "doc_id", "left")
    lines, sources = (F.coalesce(F.col(f"gone.{c}"), F.array().cast(kind)) for c, kind in (("line_no", "array<int>"), ("keep_doc_id", f"array<{docs.schema['doc_id'].dataType.simpleString()}>")))
    return met.select("doc_id", "n_lines", (F.col("n_lines") - F.size(lines)).alias("n_kept"), lines.alias("dropped"), sources.alias("kept_from"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines gone from ``text``; the columns stay as they are, texts without a doc_id too."""
    gone = dropped_lines(docs, min_words).where(F.size("dropped") > 0).select(F.col("doc_id").alias("gone_id"), F.col("dropped").alias("gone_lines"))
    joined = docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone_lines", i)), "\n")
    return joined.withColumn("text", F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(rest)).select(docs.columns)

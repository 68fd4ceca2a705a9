"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Signatures: two permutations of the 32-bit numbers serve all coordinates. The first scatters the
shingles; the second is read from places shifted round the circle by 0, 1, 2, ... .

Candidates: a band's bucket is not expanded into pairs. Every member is paired with one centre, the
first member; the pairs are verified on the full sets, and components are built from the links. In a second round
the members outside a bucket's largest component meet another member of that component, a different one in
each bucket, so that a large family becomes one component by pairs in proportion to its members. Whoever is
still outside is then tried against all texts of such buckets from which it is apart, found by exact
filters on their rarest shingles and parity bitmaps. So no link is lost between texts that share a
bucket, and a bucket that is one component costs no further pair.

Links are confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import cut, one_row_each, spend, tidy
from .components import components, contracted, part_labels


@dataclass(frozen=True)
class Settings:
    """Defaults for two-word shingles at 0.8: a pair at the threshold is missed with probability 5e-8."""

    words: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 4
    seed: int = 7


def _scatter(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    h, _, _, bounds = _text.words(data, offsets, _text.SPACE, _text.FOLD)
    grams = np.full(max(h.size - width + 1, 0), width, dtype=np.uint64)
    for i in range(width):
        grams = _text.mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : i + grams.size])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            one = np.sort(grams[a : b - width + 1])
            out.append(one[np.append(True, one[1:] != one[:-1])])
        elif b > a:
            x = np.full(1, b - a, dtype=np.uint64)
            for i in range(a, b):
                x = _text.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, size: int, seed: int, step: int = 2048) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set that is not empty."""
    placed = _scatter((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(seed))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, placed.size, step):
        np.minimum(best, _scatter(placed[None, i : i + step] + shift).min(axis=1), out=best)
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


#: Words of a set's parity bitmap.
PARITY_WORDS = 8
#: The pairs of one centre are dealt into so many parts at most, and its text travels once to each.
PARTS = 1024
#: Pairs of the rest are compared in shares that grow by this factor, if there are more than so many for each node.
SHARE_STEP = 8
#: Sizes within one band differ by this factor at most.
SIZE_STEP = 1.1


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For each of 512 buckets, whether an odd number of the set's shingles fall into it."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(s: Settings):
    """mapInArrow body over (doc_id, sha, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch.column(2)):
                sets = shingle_sets(data, offsets, s.words)
                full = [i for i, x in enumerate(sets) if x.size]
                signs = np.stack([signature(sets[i], s.bands * s.rows, s.seed) for i in full]) if full else np.zeros((0, s.bands * s.rows), np.uint32)
                odd = np.stack([_parity(sets[i]) for i in full]) if full else np.zeros((0, PARITY_WORDS), np.int64)
                some = np.array([x.size > 0 for x in sets])
                lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(some * width)).astype(np.int32), values.ravel()) for width, values in ((s.bands, band_keys(signs, s.bands, s.rows)), (PARITY_WORDS, odd))]
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if x.size else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.size for x in sets], pa.int64()), pa.array(keys, pa.binary()), *lists],
                    names=["doc_id", "sha", "n_shingles", "set_key", "bands", "parity"],
                )

    return run


def _verify(s: Settings):
    """mapInArrow body over (a, b, text) in order: a centre's text (b is null), then those it is compared with; the pairs whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            alike = []
            centre = batch.column(1).is_null().to_pylist()
            for a, _, data, offsets in _text.slices(batch.column(2)):
                for i, y in enumerate(shingle_sets(data, offsets, s.words)):
                    if centre[a + i]:
                        x = y
                        alike.append(False)
                        continue
                    few, many = min(x.size, y.size), max(x.size, y.size)
                    if 100 * few < s.percent * many or not few:
                        alike.append(False)
                        continue
                    both = np.sort(np.concatenate((x, y)))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    alike.append(100 * common >= s.percent * (x.size + y.size - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return run


def _classes(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha of the text, n_shingles, set_key), and classes of rows with equal sets.

    A class has a node, numbered in the order of its first row (by doc_id, nulls last), that row's doc_id
    and sha, the set's size and parity words, and its bands.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"), "text")
    rows = cut(base.mapInArrow(tidy(_describe(s)), f"doc_id {kind}, sha binary, n_shingles long, set_key binary, bands array<long>, parity array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sha")).alias("first")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(first, F.first(F.struct("n_shingles", "bands", "parity")).alias("set"))
    ordered = classes.repartitionByRange("first", "set_key").sortWithinPartitions("first", "set_key").withColumn("node", F.monotonically_increasing_id())
    words = [F.col("set.parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)]
    classes = cut(ordered.select("node", "set_key", F.col("first.doc_id").alias("first_id"), F.col("first.sha").alias("first_sha"), F.col("set.n_shingles").alias("size"), *words, F.col("set.bands").alias("bands")))
    narrow = cut(rows.drop("bands", "parity"))
    spend(rows)
    return narrow, classes


def _centres(members: DataFrame) -> DataFrame:
    """bucket, centre and n of buckets with two members or more: the first, for originals mostly precede their copies. Any choice gives the same groups.

    Written, so that the join with it is free to split a large bucket's members over tasks.
    """
    return cut(members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"))


def _close(s: Settings, x: str, y: str) -> Column:
    """Whether sizes and parity words let two sets be alike enough: sets differ in no fewer shingles than their bitmaps in bits."""
    sizes = F.least(f"{x}size", f"{y}size") * 100 >= F.greatest(f"{x}size", f"{y}size") * s.percent
    differ = sum((F.bit_count(F.col(f"{x}p{i}").bitwiseXOR(F.col(f"{y}p{i}"))) for i in range(1, PARITY_WORDS)), F.bit_count(F.col(f"{x}p0").bitwiseXOR(F.col(f"{y}p0"))))
    return sizes & (differ * (100 + s.percent) <= (F.col(f"{x}size") + F.col(f"{y}size")) * (100 - s.percent))


def _marked(marks: DataFrame, by: str) -> DataFrame:
    """``marks`` with the node as ``by`` and the other columns prefixed with it."""
    return marks.select(F.col("node").alias(by), *(F.col(c).alias(f"{by}_{c}") for c in marks.columns if c != "node"))


def _links(pairs: DataFrame, marks: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough. Many pairs of one ``a`` are dealt over tasks, and its text goes once to each part."""
    near = cut(pairs.join(_marked(marks, "a"), "a").join(_marked(marks, "b"), "b").where(_close(s, "a_", "b_")).select("a", "b"))
    dealt = near.select("a", "b", F.expr(f"pmod(xxhash64(b), {PARTS})").alias("part"))
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("node")).select("a", "part", "b", "text")
    rows = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = cut(rows.select("a", "b", "text").mapInArrow(tidy(_verify(s)), "a long, b long"))
    spend(near)
    return out


def _grouped(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node and the node's component, of ``members``."""
    mine = found.select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    return cut(members.join(mine, F.col("node") == F.col("_node"), "left").select("bucket", "node", F.coalesce("_group", "node").alias("group")))


def _main(grouped: DataFrame) -> DataFrame:
    """bucket, main and pick of buckets with more than one component: the largest one, and one of its members by a hash."""
    each = grouped.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("pick"))
    best = each.groupBy("bucket").agg(F.max(F.struct("n", "group", "pick")).alias("best"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return cut(best.select("bucket", F.col("best.group").alias("main"), F.col("best.pick").alias("pick")))


def _shingle_rows(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch.column(3), _text.BLOCK):
                sets = shingle_sets(data, offsets, s.words)
                size = np.array([x.size for x in sets])
                at = pa.array(np.repeat(np.arange(a, b), size))
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(flat)], names=["node", "group", "query", "shingle"])

    return run


def _size_band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _rest(grouped: DataFrame, marks: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs that the rounds leave open: members outside their bucket's largest component, with all from which they are apart.

    Two sets that are alike enough share one of their rarest shingles, and at such places in the
    order by rarity that enough can follow; so pairs come from an equi-join on rare shingles (and on
    the size band), never from a bucket's members times themselves. The join checks sizes and parity
    words too. All filters are exact.
    """
    pool = grouped.join(_main(grouped).drop("pick"), "bucket").groupBy("node", "group").agg(F.bool_or(F.col("group") != F.col("main")).alias("query"))
    rows = pool.join(texts, "node").select("node", "group", "query", "text")
    rows = cut(rows.mapInArrow(tidy(_shingle_rows(s)), "node long, group long, query boolean, shingle long"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")) - 1
    rare = rows.join(shared.where("df > 1"), "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place).where("df > 1").join(marks, "node")
    rare = rare.withColumn("left_over", F.col("size") - F.col("place")).where(F.col("left_over") * 100 >= F.col("size") * s.percent)
    # Of sizes x and y at least p/(100+p)*(x+y) shingles must be common, and no more than are left over.
    largest = F.least(F.floor(F.col("left_over") * (100 + s.percent) / s.percent) - F.col("size"), F.floor(F.col("size") * 100 / s.percent))
    smallest = F.greatest(F.ceil(F.col("size") * s.percent / 100), F.lit(1))
    bands = F.when(largest >= smallest, F.sequence(_size_band(smallest), _size_band(largest)))
    kept = ["node", "group", "left_over", *(c for c in marks.columns if c != "node")]
    one = rare.where("query").select("shingle", F.explode(bands).alias("band"), *(F.col(c).alias(f"x_{c}") for c in kept))
    two = rare.select("shingle", _size_band(F.col("size")).alias("band"), *(F.col(c).alias(f"y_{c}") for c in kept))
    enough = F.least("x_left_over", "y_left_over") * (100 + s.percent) >= (F.col("x_size") + F.col("y_size")) * s.percent
    met = one.join(two, ["shingle", "band"]).where((F.col("x_group") != F.col("y_group")) & enough & _close(s, "x_", "y_"))
    out = cut(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    spend(rows)
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = [found.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_of_{x}")) for x in "ab"]
    both = pairs.join(of[0], F.col("a") == F.col("_a"), "left").join(of[1], F.col("b") == F.col("_b"), "left")
    return both.where(F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")).select("a", "b")


def _joined(rest: DataFrame, links: DataFrame, marks: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``links``, and as many links of the pairs of ``rest`` as give all components.

    If the pairs are many, a share of them by a hash is compared first, and then of larger ones those that the
    links so far leave apart. Between components of a random share of links there are, as expected, no more
    links than nodes divided by the share; so each step adds links in proportion to the nodes, not to the pairs.
    """
    n_pairs = rest.count()
    if not n_pairs:
        return links
    n_nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    share = 1
    while share * SHARE_STEP * n_nodes < n_pairs:
        share *= SHARE_STEP
    if share == 1:
        return links.unionByName(_links(rest, marks, texts, s))
    place = F.xxhash64("a", "b")
    done = F.lit(False)
    while share:
        found = components(links)
        links = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        left = rest.where((F.pmod(place, F.lit(share)) == 0) & ~done)
        links = links.unionByName(_links(_apart(left, found), marks, texts, s))
        done = F.pmod(place, F.lit(share)) == 0
        share //= SHARE_STEP
    return links


def near_classes(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha, n_shingles, set_key) of ``docs``, and for each set_key: the first doc_id of its component, and the first row (first_id, first_sha) of its class if the class is the component's first."""
    rows, classes = _classes(docs, s)
    marks = classes.drop("set_key", "first_id", "first_sha", "bands")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    members = cut(entries.join(_centres(entries), "bucket").select("bucket", "node", "centre", "n"))
    wanted = members.select("node").distinct().join(classes.select("node", "first_id", "first_sha"), "node")
    told = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"), "text").withColumn("place", F.xxhash64("doc_id", "sha"))
    held = told.join(wanted.withColumn("place", F.xxhash64("first_id", "first_sha")), "place").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("first_sha")))
    texts = cut(held.dropDuplicates(["place", "node"]).select("node", "text"))
    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    # The components that pairs are chosen by may be too small; those that count are made last.
    links = contracted(_links(pairs, marks, texts, s))
    open_ones = members.where("n > 2").select("bucket", "node")
    grouped = _grouped(open_ones, part_labels(links))
    again = grouped.join(_main(grouped), "bucket").where("group <> main").select(F.col("pick").alias("a"), F.col("node").alias("b")).distinct()
    links = contracted(links.unionByName(_links(again, marks, texts, s)))
    spend(grouped)
    grouped = _grouped(open_ones, part_labels(links))
    rest = _rest(grouped, marks, texts, s)
    found = components(_joined(rest, links, marks, texts, s))
    for table in (grouped, members, texts):
        spend(table)

    heads = classes.select(F.col("node").alias("component"), F.col("first_id").alias("component_id"))
    leads = F.col("node") == F.col("component")
    mine = classes.select("node", "set_key", "first_id", "first_sha").join(found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    moved = mine.where("component is not null").join(heads, "component").select("set_key", "component_id", F.when(leads, F.col("first_id")).alias("first_id"), F.when(leads, F.col("first_sha")).alias("first_sha"))
    alone = mine.where("component is null").select("set_key", F.col("first_id").alias("component_id"), "first_id", "first_sha")
    return rows, moved.unionByName(alone)


def near_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Texts are linked when the Jaccard similarity of their shingle sets is ``s.percent`` / 100 or
    more; a component's smallest doc_id names it and is the one kept. A null or empty text is linked
    with nothing and is its own component. Rows with equal sets are one class from the start, however
    many. A null doc_id can't be a component: such a row is in its class's component, or in null, and
    isn't kept. Rows that repeat a doc_id are judged by their own texts. An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    rows, named = near_classes(docs, s)
    full = rows.where("set_key is not null").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    out = full.unionByName(rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, one with the smallest doc_id; the columns stay as they are.

    Rows are told apart by doc_id and text: a doc_id with several texts stays with each that leads its
    group. A row without a doc_id stays only if all of its group have none. Of rows that repeat both, the
    one that is least by its other columns stays. Texts without a word are linked with nothing and stay.
    """
    rows, named = near_classes(docs, s)
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("first_sha"))
    full = rows.where("set_key is not null").join(named, "set_key").select("doc_id", "sha", F.coalesce(first, F.lit(False)).alias("stays"))
    return one_row_each(docs, full.unionByName(rows.where("set_key is null").select("doc_id", "sha", F.lit(True).alias("stays"))))

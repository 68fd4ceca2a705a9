"""Near-duplicate groups against all pairs of sets."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import components as G
from kvlake.llm import minhash as M

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width: int = 2, percent: int = 80) -> dict[int, tuple]:
    sets = {d: shingles(t, width) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def corpus(n_bases: int, copies: int, seed: int) -> list[tuple]:
    """Families of texts at all distances from their base, so that many pairs lie just on either side of the limit."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [r.choice(vocabulary) for _ in range(r.choice((3, 8, 30, 120)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 5))):
                w[r.randrange(len(w))] = r.choice(vocabulary[:20])
            rows.append((len(rows), r.choice((" ", "\n", "\t ")).join(w).upper() if r.random() < 0.1 else " ".join(w)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    rows = [*corpus(12, 25, width), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "É é"), (906, "é é"), (907, "a b " * 20_000)]
    got = M.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), M.Settings(words=width)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, width)


def test_the_rest_is_searched_for(spark):
    """A hot family in which most members are apart from the bucket's smallest."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(80), 12 if i < 100 else 3):
            w[at] = f"x{i // 2}.{at}" if i % 2 else f"x{i}.{at}"
        rows.append((i, " ".join(w)))
    got = M.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(rows)


def test_links_of_the_rest_grow_with_the_members(spark, monkeypatch):
    """All members of a family are left apart until the rest is searched; most of its pairs are links."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    nobody = spark.createDataFrame([], "node long, component long")
    seen, whole = [], M.components
    monkeypatch.setattr(M, "part_labels", lambda links: nobody)
    monkeypatch.setattr(M, "_main", lambda grouped: grouped.groupBy("bucket").agg(F.min("group").alias("main"), F.min("node").alias("pick")))
    monkeypatch.setattr(M, "contracted", lambda links: links.where("false"))
    monkeypatch.setattr(M, "components", lambda links: seen.append(links.select("a", "b").distinct().count()) or whole(links))
    got = M.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(rows)
    assert max(seen) <= 16 * len(rows), seen


def test_repeated_rows_nulls_and_other_columns(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "a b c d", 0), (None, "a b c d", 0), (None, "z", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(map(tuple, M.near_groups(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 1, None, False), (None, 0, None, False)], key=str)
    assert M.near_groups(df.where("false")).collect() == []
    left = M.drop_near_copies(df)
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=str) == [(1, "a b c d", 0), (None, "z", 0), (None, None, 0)]


def test_one_row_of_each_group_stays(spark):
    rows = [
        (7, "twice a b c", "x"), (7, "only here d e f", "x"), (9, "twice a b c", "x"),  # an id with two texts, of which one has a copy
        (5, "p q r s", "y"), (5, "P q  r s", "x"), (5, "p q r s", "x"), (6, "P Q R S", "x"),  # rows of one id whose sets are equal
        (None, "n o", "x"), (None, "n o", "x"), (None, "", "x"), (3, "", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_sha string").repartition(3)
    got = sorted(map(tuple, M.drop_near_copies(df).collect()), key=str)
    texts = [t for d, t, _ in got if d == 5]
    assert len(texts) == 1 and texts[0].lower().split() == ["p", "q", "r", "s"]
    assert [x for x in got if x[0] != 5] == sorted([(7, "twice a b c", "x"), (7, "only here d e f", "x"), (None, "n o", "x"), (None, "", "x"), (3, "", "x")], key=str)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 2000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        k = int(2000 * 2 * share / (1 + share))
        x, y = np.sort(base), np.sort(np.concatenate((base[:k], r.integers(0, 2**63, 2000 - k, dtype=np.uint64))))
        same = np.mean(M.signature(x, 1024, 7) == M.signature(y, 1024, 7))
        assert abs(same - share) < 0.06


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (7, 7)]
    r.shuffle(edges)
    got = {x.node: x.component for x in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 400), 100) | {500: 500, 501: 500}
    assert G.components(spark.createDataFrame([], "a long, b long")).collect() == []

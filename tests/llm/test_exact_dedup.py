"""Exact dedup against grouping by text, also with fingerprints that collide."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from kvlake.llm import exact_dedup as X

SCHEMA = "doc_id long, text string"


def brute(rows) -> list[tuple]:
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d is not None and d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def rows_of(n: int) -> list[tuple]:
    r = random.Random(8)
    texts = ["".join(r.choice("abé") for _ in range(r.randrange(12))) for _ in range(40)] + ["x" * 5000, "x" * 5001, "y" + "x" * 4999]
    return [(i, r.choice(texts)) for i in range(n)] + [(n, None), (n + 1, ""), (None, "a"), (None, None), (7, "twice"), (7, "twice"), (8, "other text of an id")]


@pytest.mark.parametrize(
    ("chunk", "huge", "primes"),
    [(X.CHUNK, 1 << 24, X.PRIMES), (16, 40, X.PRIMES), (16, 40, (3, 2)), (1000, 1, (5, 7))],
    ids=["whole", "cut", "colliding", "all cut and colliding"],
)
def test_equals_grouping(spark, chunk, huge, primes):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, X.exact_groups(df, chunk, huge, primes).collect()), key=str) == brute(rows)


def test_hashes_compose():
    data = np.frombuffer(random.Random(1).randbytes(1000), np.uint8)
    tables = [X._power_table(b, p, 1000) for b, p in zip(X.BASES, X.PRIMES, strict=True)]
    whole = X.chunk_hash(data, tables, X.PRIMES)
    for cut in (0, 1, 17, 999):
        parts = [(X.chunk_hash(data[:cut], tables, X.PRIMES), 0), (X.chunk_hash(data[cut:], tables, X.PRIMES), cut)]
        assert X.join_hashes(parts, X.PRIMES) == X.join_hashes(parts[::-1], X.PRIMES) == whole


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5, True), (2, "a", 6, False)], "doc_id long, text string, group_size long, kept boolean")
    assert [r.keep_id for r in X.exact_groups(df).collect()] == [2, 2]
    assert X.exact_groups(df.where("false")).collect() == []
    left = X.drop_copies(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(2, "a", 6, False)]


def test_hot_group(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    got = X.exact_groups(df).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in got} == {(2000, True): 1, (2000, False): 1999, (1, True): 4000}


def test_one_row_of_each_text_stays(spark):
    rows = [
        (1, "lost", "a"), (2, "lost", "a"), (1, "unique", "a"),  # an id with two texts, of which one is lost
        (3, "again", "b"), (3, "again", "b"), (3, "again", "a"),  # an id with one text, three times
        (None, "again", "a"), (None, "nameless", "b"), (None, "nameless", "a"), (None, None, "c"), (4, "", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = [(2, "lost", "a"), (1, "unique", "a"), (3, "again", "a"), (None, "nameless", "a"), (4, "", "c")]
    left = X.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    assert X.drop_copies(df.where("false")).collect() == []

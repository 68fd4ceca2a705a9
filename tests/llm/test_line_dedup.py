"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random

from kvlake.llm import line_dedup as L


def words(line: str) -> list[str]:
    return [w for w in line.translate(L._ONE_SPACE).split(" ") if w]


def brute(docs) -> dict:
    lines = sorted((d, k, words(line)) for d, text in docs for k, line in enumerate((text or "").split("\n")) if words(line))
    out = {}
    for i, (d, k, w) in enumerate(lines):
        near = (x[:2] for x in lines[:i] if x[2] == w or (min(len(w), len(x[2])) >= L.MIN_WORDS and L.within_one_edit(w, x[2])))
        out[d, k] = next(near, None)
    return out


def test_equals_all_pairs(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(" ".join(r.choice("abcd") for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 6)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " \n\n x  y "), (503, "x\ty\n" + "é " * 30_000), (504, "é " * 30_001)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.line_no): (x.keep_doc_id, x.keep_line_no) if x.dropped else None for x in L.line_verdicts(df).where("line_no >= 0").collect()}
    assert got == brute(docs)
    assert got[503, 0] == (502, 2) and got[504, 0] == (503, 1)


def test_defined_cases(spark):
    text = "a b c d e f\nz\na b c d e f"
    rows = [(1, text, 0), (1, text, 0), (2, "a b X d e f\n\nq", 0), (None, text, 0), (3, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {x.doc_id: (x.n_lines, x.n_kept, x.dropped, x.kept_from) for x in L.dropped_lines(df).collect()}
    assert got == {1: (3, 2, [2], [1]), 2: (3, 2, [0], [1]), 3: (1, 1, [], [])}
    assert L.dropped_lines(df.where("false")).collect() == []
    clean = L.drop_repeated_lines(df)
    assert clean.columns == df.columns
    assert sorted(clean.collect(), key=str) == sorted(spark.createDataFrame([(1, "a b c d e f\nz", 0), (1, "a b c d e f\nz", 0), (2, "\nq", 0), (None, text, 0), (3, None, 0)], df.schema).collect(), key=str)


def test_hot_line(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'one very common line of words' else concat('line ', id, ' of its own kind ', id * 7) end as text")
    got = L.dropped_lines(df).selectExpr("sum(size(dropped)) as n", "min(if(size(dropped) > 0, kept_from[0], 0)) as a", "max(if(size(dropped) > 0, kept_from[0], 0)) as b").first()
    assert tuple(got) == (999, 0, 0)

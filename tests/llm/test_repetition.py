"""Quality counts and repeats against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np

from kvlake.llm import _text
from kvlake.llm import repetition as R
from kvlake.llm.queries import QUERIES


def brute(text: str | None, limits: R.Limits) -> tuple:
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    n = len(w)
    reach = [max((next(k for k in range(n + 1) if max(i, j) + k >= n or w[i + k] != w[j + k]) for j in range(n) if j != i), default=0) for i in range(n)]
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    passages = {i + k for i in range(n) if reach[i] >= limits.min_repeat for k in range(reach[i])}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    longest = max(reach, default=0)
    failed = n < limits.min_words or 100 * len(covered) > limits.max_window_percent * n
    kept = not failed and len(passages) <= limits.max_covered * n and longest <= limits.max_longest
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(passages), longest, failed, kept


def texts(n: int) -> list[str | None]:
    r = random.Random(9)
    out: list[str | None] = [None, "", " \n ", "a", "a " * 60, "é é\x1cé # * b", "same\nsame\n\n\n x \n x "]
    for _ in range(n):
        vocabulary = [f"w{i}" for i in range(r.choice((2, 6, 40, 300)))] + ["#x", "ü|"]
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 90))]
        if w and r.random() < 0.6:
            at, size = r.randrange(len(w)), r.randrange(1, 30)
            w += w[at : at + size] + ["gap"] * r.randrange(2) + w[at : at + size]
        out.append("".join(x + r.choice((" ", " ", "\n", "\t")) for x in w))
    return out


def test_equals_plain_python(spark):
    limits = R.Limits(min_repeat=6, max_covered=0.15, max_longest=20)
    rows = list(enumerate(texts(150)))
    got = R.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limits).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: brute(t, limits) for d, t in rows}


def test_order_is_that_of_a_suffix_array():
    r = random.Random(1)
    word = np.array([r.randrange(3) for _ in range(200)], dtype=np.uint64)
    bounds = np.array([0, 80, 81, 200])
    size = np.diff(bounds)
    owner, end = np.repeat(np.arange(3), size), np.repeat(bounds[1:], size)
    order, levels = R.suffix_array(word, owner, end)
    first = levels[0]
    for a, b in zip(order, order[1:], strict=False):
        assert list(first[a : end[a]]) < list(first[b : end[b]])


def test_long_texts_do_not_depend_on_slices():
    r = random.Random(2)
    text = " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(120_000))
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, data.size])
    h, s, e, bounds = _text.words(data, offsets)
    split = text.split(" ")
    assert list(bounds) == [0, len(split)]
    assert [text[a:b] for a, b in zip(s, e, strict=True)] == split
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(split, h.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "x " * 30, 0), (1, "x " * 30, 0), (None, None, 0)], "doc_id long, text string, kept long")
    got = R.judge(df).collect()
    assert len(got) == 3 and got[0] == got[1] and not any(r.kept for r in got)
    assert R.judge(df.where("false")).collect() == []


def test_registered_limits_refuse_what_the_base_rule_passes(spark, tmp_path):
    new = iter(range(100_000))
    fresh = lambda n: " ".join(f"w{next(new)}" for _ in range(n))
    passage, long_one = fresh(20), fresh(60)
    rows = [
        (1, " ".join((passage, fresh(220), passage))),  # 40 of 260 words repeated: 15 %
        (2, " ".join((long_one, fresh(1400), long_one))),  # 120 of 1520 words: 8 %, in one repeat of 60
        (3, " ".join((passage, fresh(500), passage))),  # 40 of 540 words: 7 %
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.covered_words, r.longest_repeat, r.base_failed, r.kept) for r in QUERIES["op6_quality_rules"](spark, str(tmp_path)).collect()}
    assert got == {1: (40, 20, False, False), 2: (120, 60, False, False), 3: (40, 20, False, True)}

"""The toxicity model: held-out accuracy, scores against plain Python, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np

from kvlake.llm import _text
from kvlake.llm import toxicity as T

S = T.Settings(bits=18, sample=2000)


def made(n: int, seed: int) -> list[tuple[int, str, int]]:
    r = random.Random(seed)
    plain, rude = [f"word{i}" for i in range(500)], ["idiotic", "Moronic", "trashy!", "stupidest"]
    out = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(5, 80))]
        bad = r.random() < 0.15
        for _ in range(r.randrange(2, 5) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(rude))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = made(2500, 1)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 3], "doc_id long, toxic int")
    model = T.train(docs, labels, S)
    assert 0 < model[0].size < 5000
    got = {r.doc_id: r.score for r in T.score(docs, model, S).collect()}
    held = [(got[d] >= S.threshold, y == 1) for d, _, y in rows if d % 3 == 0]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    again = T.train(docs.repartition(7), labels, S)
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))
    left = T.drop_toxic(docs.selectExpr("text", "doc_id", "1 as score"), labels, S)
    assert left.columns == ["text", "doc_id", "score"]
    assert {r.doc_id for r in left.collect()} == {d for d, x in got.items() if x < S.threshold}


def test_scores_are_sums_over_distinct_features():
    data = np.frombuffer(b"One two one two. THREE", np.uint8)
    ids, bounds = T.features(data, np.array([0, 8, data.size]), 16)
    assert len(set(ids[bounds[0] : bounds[1]])) == bounds[1] == len({"one", "two", "5:one", "5:two", "7:one", "7:two", "one two"})
    upper = T.features(np.frombuffer(b"ONE  TWO", np.uint8), np.array([0, 8]), 16)[0]
    assert sorted(upper) == sorted(ids[: bounds[1]])


def test_a_stem_that_comes_again_is_a_feature_of_its_own():
    def count(text: bytes) -> int:
        return T.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 30)[0].size

    # Words, stems of 5 and of 7 bytes, stems that come again, pairs, pairs one word apart.
    assert count(b"stupidly x stupidity") == 3 + 2 + 3 + 1 + 2 + 1
    assert count(b"stupids stupids stupids") == 1 + 1 + 1 + 2 * 2 + 1 + 1
    assert count(b"stupids " * 9) == 1 + 1 + 1 + 2 * 3 + 1 + 1
    data = np.frombuffer(b"stupidsstupids", np.uint8)
    assert T.features(data, np.array([0, 7, 14]), 30)[1].tolist() == [0, 3, 6]  # not across texts


def test_packed_buckets_come_back():
    r = np.random.default_rng(5)
    rows = [np.sort(r.choice(1 << 20, n, replace=False)) for n in (0, 1, 3, 5000, 0, 2, 0)] + [np.array(x) for x in ([0], [65535], [0, 65535, 65536], [65534], [131070, 1048575])]
    bounds = np.append(0, np.cumsum([x.size for x in rows]))
    gaps, at = T.packed(np.concatenate(rows).astype(np.int32), bounds)
    assert gaps.dtype == np.uint16 and all(np.array_equal(T.unpacked(gaps[a:b]), x) for a, b, x in zip(at, at[1:], rows, strict=False))
    assert T.packed(np.zeros(0, np.int32), np.array([0, 0, 0]))[1].tolist() == [0, 0, 0]


def test_ftrl_learns_and_forgets_rare_features():
    r = random.Random(2)
    rows = [(np.array(sorted({7 if y else 9, 100 + r.randrange(50), 1000 + i}), np.int32), y) for i, y in enumerate(r.randrange(2) for _ in range(400))]
    ids, w, _ = T.learn(rows, S)
    weight = dict(zip(ids.tolist(), w.tolist(), strict=True))
    assert weight[7] > 0.5 > 0 > weight[9] and not any(i >= 1000 for i in weight)


def plain_ftrl(rows, s: T.Settings) -> tuple[dict[int, float], float]:
    """FTRL-proximal written out coordinate by coordinate, with a bias that is not held back by L1."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i: int) -> float:
        zi, l1 = z.get(i, 0.0), 0.0 if i == -1 else s.l1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for buckets, label in rows:
            at = [*buckets, -1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if i != -1 and (w := weight(i))}, weight(-1)


def test_equals_plain_ftrl():
    r = random.Random(11)
    s = T.Settings(bits=12, l1=0.7, l2=0.3, alpha=0.5, epochs=3)
    rows = [(np.array(sorted(r.sample(range(60), r.randrange(0, 9)) + ([99] if y else [])), np.int32), y) for y in (r.randrange(2) for _ in range(150))]
    ids, w, bias = T.learn(rows, s)
    want, want_bias = plain_ftrl([(x.tolist(), y) for x, y in rows], s)
    assert math.isclose(bias, want_bias, rel_tol=1e-9) and ids.tolist() == sorted(want)
    assert all(math.isclose(a, want[i], rel_tol=1e-9) for i, a in zip(ids.tolist(), w.tolist(), strict=True))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, "", 0), (None, "x " * 100_000, 0), (3, "a b", 0)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels, S)
    got = T.score(docs, model, S).collect()
    assert len(got) == 5 and len({r.score for r in got[:3]}) == 1
    none = T.train(docs, labels.where("false"), S)
    assert none[0].size == 0 and none[2] == 0.0
    assert {r.score for r in T.score(docs, none, S).collect()} == {0.5}
    assert T.score(docs.where("false"), none, S).collect() == []
    assert math.isclose(got[0].score, 1 / (1 + math.exp(-model[2])))
    assert _text.words(np.zeros(0, np.uint8), np.array([0, 0]))[0].size == 0

"""Budgets and selection against a plain recursive version."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from kvlake.llm import mixing as X

SCHEMA = "doc_id long, text string, lang string, source string"
PLAN = X.Plan(domains={"s0": "web", "s1": "web", "s2": "books"}, domain_weights={"web": 3, "books": 2}, lang_weights={"en": 4, "xx": 0}, source_weights={"s1": 5}, percent=70, max_epochs=3, seed=5)


def split(budget: int, children: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Round by round: full children take their cap, the rest share what is left."""
    open_ = {k: v for k, v in children.items() if v[1] > 0}
    out = {}
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap * total <= budget * w]
        if not full:
            return out | {k: budget * w // total for k, (_, w) in open_.items()}
        for k in full:
            out[k] = open_[k][0]
        budget -= sum(open_.pop(k)[0] for k in full)
    return out


def brute(rows, plan: X.Plan) -> Counter:
    leaves = defaultdict(list)
    for d, text, lang, source in rows:
        leaf = plan.domains.get(source or "", "other"), lang or "", source or ""
        leaves[leaf].append((d, len(re.findall("[^\x20\x09-\x0d]+", text or ""))))
    tokens = {leaf: sum(n for _, n in x) for leaf, x in leaves.items()}
    weight = lambda names, k: names.get(k, 1)
    weights = lambda leaf: (weight(plan.domain_weights, leaf[0]), weight(plan.lang_weights, leaf[1]), weight(plan.source_weights, leaf[2]))
    caps = {leaf: n * plan.max_epochs for leaf, n in tokens.items() if all(weights(leaf))}

    def family(prefix: tuple, depth: int) -> dict[str, tuple[int, int]]:
        out = defaultdict(int)
        for leaf, cap in caps.items():
            if leaf[:depth] == prefix:
                out[leaf[depth]] += cap
        names = (plan.domain_weights, plan.lang_weights, plan.source_weights)[depth]
        return {k: (c, weight(names, k)) for k, c in out.items()}

    out = Counter()
    for domain, b1 in split(sum(tokens.values()) * plan.percent // 100, family((), 0)).items():
        for lang, b2 in split(b1, family((domain,), 1)).items():
            for source, budget in split(b2, family((domain, lang), 2)).items():
                leaf = domain, lang, source
                if not budget or not tokens[leaf]:
                    continue
                whole, rest = divmod(budget, tokens[leaf])
                out.update((d, e) for d, _ in leaves[leaf] for e in range(whole))
                order = sorted(leaves[leaf], key=lambda x: (hashlib.md5(f"{plan.seed}|{whole}|{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1]))
                run = 0
                for d, n in order:
                    run += n
                    if rest and run <= rest:
                        out[d, whole] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, "w " * r.randrange(0, 40), r.choice(("en", "en", "de", "xx", None)), r.choice(("s0", "s0", "s0", "s1", "s2", "s3", None))) for i in range(900)]
    return [*out, (1000, None, "en", "s2"), (1000, None, "en", "s2"), (None, "a b", "de", "s3"), (1001, "w " * 30_000, "de", "s2")]


@pytest.mark.parametrize("percent", [1, 40, 100, 290, 1000])
def test_equals_recursion(spark, rows, percent, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_ROWS", 10)
    plan = X.Plan(**{**PLAN.__dict__, "percent": percent})
    got = X.select(spark.createDataFrame(rows, SCHEMA).repartition(4), plan).collect()
    assert Counter((x.doc_id, x.epoch) for x in got) == brute(rows, plan)


def test_shortage_goes_to_siblings_before_ancestors():
    # books/de can't hold its share; books/en takes it, and web only what books can't hold at all.
    assert split(100, {"de": (10, 1), "en": (500, 1)}) == {"de": 10, "en": 90}
    assert split(100, {"books": (30, 1), "web": (500, 1)}) == {"books": 30, "web": 70}


def test_tables_without_rows_and_other_columns(spark, rows):
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", domain long, epoch long")
    assert X.select(df.where("false")).collect() == []
    plan = X.Plan(percent=50, max_epochs=1)
    kept = X.keep_selected(df, plan)
    assert kept.columns == df.columns
    ids = {d for (d, _), n in brute(rows, plan).items() if d is not None}
    assert {r.doc_id for r in kept.collect()} == ids
    with pytest.raises(ValueError):
        X.keep_selected(df, PLAN)


def test_rows_without_tokens_or_ids(spark):
    # s4 holds no token at all; the weight of xx is 0; 12 of 24 tokens go, and those without an id are half of the supply.
    rows = [(1, None, "en", "s4"), (2, " ", "en", "s4"), (None, "", "en", "s4"), (3, "", "xx", "s4"), (None, None, None, "s5")]
    rows += [(10 + i, "a b", "en", "s1") for i in range(6)] + [(None, f"a {i}", "en", "s3") for i in range(6)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], SCHEMA + ", n long").repartition(3)
    plan = X.Plan(lang_weights={"xx": 0}, percent=50, max_epochs=1)
    free = {0, 1, 2, 4}
    assert {0, 1} < {r.n for r in X.keep_selected(df, plan).collect()}
    kept = X.keep_selected(df, plan, unnamed=True)
    assert kept.columns == df.columns
    got = [r.n for r in kept.collect()]
    assert len(got) == len(set(got)) == len(free) + 6 and free < set(got) and 3 not in got
    assert sum(n >= 11 for n in got) == 3
    # The SQL of the query gives no rows for a leaf without tokens.
    assert {(r.doc_id, r.source) for r in X.select(df, plan).collect()} <= {(None, "s3")} | {(10 + i, "s1") for i in range(6)}
    assert {r.n for r in X.keep_selected(df.where("source in ('s4', 's5')"), plan, unnamed=True).collect()} == free


def test_rows_of_one_id_are_taken_one_by_one(spark):
    """Half of the tokens: an id with several texts, rows alike in all columns, and rows without an id."""
    rows = [(7, f"a b {i}", "en", "s1", 0) for i in range(10)] + [(8, "c d e", "en", "s1", 0)] * 10 + [(None, "f g h", "en", "s1", 1)] * 10
    df = spark.createDataFrame(rows, SCHEMA + ", mark1 long").repartition(4)
    got = X.keep_selected(df, X.Plan(percent=50, max_epochs=1), unnamed=True)
    assert got.columns == df.columns
    found = Counter(map(tuple, got.collect()))
    assert sum(found.values()) == 15 and not found - Counter(rows)
    named = Counter(map(tuple, X.keep_selected(df, X.Plan(percent=50, max_epochs=1)).collect()))
    assert named == Counter({k: n for k, n in found.items() if k[0] is not None})

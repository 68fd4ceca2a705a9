"""Role repair against a plain dynamic programme, and independence of partitioning."""

from __future__ import annotations

import random

import pytest

from kvlake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def least_cost(roles: list[str | None]) -> int:
    """Written apart from the operator: costs of the states after each turn."""
    codes = {"system": "S", "user": "U", "human": "U", "assistant": "A", "bot": "A", "model": "A", "gpt": "A"}
    costs = {"": 0}
    for role in roles:
        r = codes.get((role or "").strip().lower(), "?")
        new: dict[str, int] = {}

        def put(state: str, cost: int, new=new) -> None:
            new[state] = min(cost, new.get(state, cost))

        for at, cost in costs.items():
            legal = {"": "SU", "S": "U", "U": "A", "A": "U"}
            for n in legal[at]:
                put(n, cost + (0 if n == r else 4))
            if at:
                put(at, cost + (1 if at == r else 5))
            once = {"S": ["U"], "U": ["A"], "A": ["U"], "": ["U"]}[at]
            for empty in once:
                if r in legal[empty]:
                    put(r, cost + 2)
                for second in legal[empty]:
                    if r in legal[second]:
                        put(r, cost + 4)
        costs = new
    return min((c + {"": 0, "S": 4, "U": 2, "A": 0}[s] for s, c in costs.items()), default=0)


def cost_of(rows) -> int:
    prices = {"keep": 0, "merge": 1, "relabel": 4, "relabel_merge": 5, "insert": 0}
    last = rows[-1].new_role
    return sum(prices[r.action] + 2 * r.n_inserted for r in rows) + {"system": 4, "user": 2, "assistant": 0}[last]


def is_legal(chat: str) -> bool:
    roles = [x.split("\n")[0] for x in chat.split("<|im_start|>")[1:]]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


@pytest.fixture(scope="module")
def chats():
    r = random.Random(5)
    names = ["system", "user", "assistant", "tool", None, "Human", " bot "]
    return {c: [(c, t, r.choice(names), f"x{c}.{t}") for t in range(r.choice((1, 2, 3, 8, 40)))] for c in range(60)} | {99: [(99, t, r.choice(names), "y" * (t % 3)) for t in range(400)]}


def test_cheapest_legal_repair_however_rows_are_dealt(spark, chats):
    rows = [x for c in chats.values() for x in c]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append(C.repair_turns(df).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    one, many = (sorted(map(tuple, f), key=str) for f in found)
    assert one == many
    for c, turns in chats.items():
        mine = sorted((r for r in found[1] if r.conv_id == c), key=lambda r: r.turn)
        assert len(mine) == len(turns)
        assert cost_of(mine) == least_cost([t[2] for t in turns]), c
        assert is_legal("".join(r.piece for r in mine))


def test_defined_cases(spark):
    rows = [(1, 0, None, None), (2, 0, "user", "a<|im_end|>"), (2, 0, "user", "a<|im_end|>"), (None, None, "assistant", ""), (3, 0, "system", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    chat = {r.conv_id: r.chat for r in C.render(df).collect()}
    assert set(chat) == {1, 2, 3, None}
    assert all(map(is_legal, chat.values()))
    assert chat[2] == "<|im_start|>user\na<| im_end|>\na<| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat[3].count("<|im_start|>") == 3 and "s<|im_end|>" in chat[3]
    assert C.repair_turns(df.where("false")).collect() == []
    more = C.repair_turns(df.selectExpr("*", "1 as action", "2 as piece"))
    assert more.columns == ["conv_id", "turn", "role", "action", "new_role", "n_inserted", "piece"]

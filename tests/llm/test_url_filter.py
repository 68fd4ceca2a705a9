"""URL rules against trying every rule on every URL."""

from __future__ import annotations

import random
import re

import pytest

from kvlake.llm import url_filter as U


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, _, path = rest.partition("/")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.translate(lower), "/" + path if "/" in rest else ""


def brute(url: str | None) -> tuple:
    host, path = parts(url)
    fits = [r for r in U.RULES if re.search(r.pattern, host + path, re.S)]
    best = max(fits, key=lambda r: (r.rank, r.name), default=None)
    return host, path, best.name if best and best.named else None, best.verdict if best else "allow"


def urls() -> list[str | None]:
    r = random.Random(3)
    out: list[str | None] = [None, "", "no", "://", "http://", "HTTP://A.ORG", "x://org/", "x://ORG/y", "x://example.org", "x://example.org/en/12", "x://www.example.org/en/2", "x://notexample.org/es/", "x://a.com/fr/?q#z", "a://b://org/", "x://org?/", "x://.org/", "x://a.free-bets.com/", "x://free-betsy.com/de/", "x://casino-win.net", "x://a.adult-x.net:80/y", "x://win-casino", "x://casinos.ads.net/", "x://mycasino.net/", "x://poker", "x://u@bets.net/", "x://x:80-bets/", "x://a:casino", "x://poker\n", "x://poker\n.net/", "x://a_bets.net/", "x://com/FR/", "x://a\nb.org/es/\n", "x://É.ORG/"]
    for _ in range(400):
        host = ".".join(r.choice(("www", "m", "example", "spam-farm", "ads-track", "a")) for _ in range(r.randrange(0, 3)))
        out.append(f"{r.choice(('http', 'https'))}://{host}.{r.choice(('org', 'com', 'net', 'ORG'))}{r.choice(('', '/', '/en/', '/es/', '/fr/', '/de/', '/en'))}{r.choice(('', '1', '12/', 'x?y=/es/', '#/de/'))}")
    return out


def test_equals_all_rules(spark):
    rows = list(enumerate(urls()))
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: brute(u) for i, u in rows}


def test_contract_rules():
    assert brute("https://www.example.org/es/1")[2:] == ("example.org/es/", "block")
    assert brute("https://example.org/en/17")[2:] == ("example.org/en/1", "block")
    assert brute("https://a.example.org/en/27")[2:] == ("org/", "allow")
    assert brute("https://x.com/de/")[2:] == ("com/de/", "block")


def test_each_rule_is_filed_under_its_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://{'example' if i < 90 else 'www'}.org/{'es' if i < 50 else 'en'}/") for i in range(100)], "page_id long, url string")
    host, path = U.split_url(df["url"])
    counts = U.token_counts(df.select(U.tokens(host, path).alias("tokens")), ["org", "example", "es", "fr"])
    assert counts["org"] == 100 and counts["example"] == 90 and counts["es"] == 50 and counts["fr"] == 0


def test_rows_rules_and_plan(spark):
    df = spark.createDataFrame([(1, "http://org/", 0), (1, "http://org/", 0), (None, None, 0)], "page_id long, url string, verdict long")
    got = U.filter_urls(df)
    assert [tuple(r) for r in got.collect()] == [(1, "org", "/", "org/", "allow")] * 2 + [(None, "", "", None, "allow")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)
    assert U.filter_urls(df.where("false")).collect() == []
    assert [r.verdict for r in U.filter_urls(df, (), "block").collect()] == ["block"] * 3
    with pytest.raises(ValueError):
        U.filter_urls(df, (U.Rule("x", "x", "block", (), 1),))


def many_rules() -> tuple[U.Rule, ...]:
    first, second = ["cheap", "free", "best", "my", "spam", "ads", "x"], [f"w{i}" for i in range(600)] + ["bets", "farm", "track"]
    made = [U.Rule(f"{a}-{b}", rf"^(?:[^/]*\.)?{a}-{b}(?:[.:/]|$)", "block" if i % 3 else "allow", (a, b), i % 7, i % 2 == 0) for a in first for i, b in enumerate(second)]
    return U.RULES + tuple(made)


def test_a_long_list_is_joined_and_agrees_with_the_map(spark):
    rules = many_rules()
    assert len(rules) > 4000
    rows = list(enumerate([*urls(), *(f"http://{a}-w{i}.net/{i}" for i in range(0, 700, 7) for a in ("cheap", "x", "none"))]))
    df = spark.createDataFrame([*rows, *rows[:20]], "page_id long, url string").repartition(3)
    by_map, by_join, by_table = (U.filter_urls(df, r, map_rules=n) for r, n in ((U.RULES, 500), (U.RULES, 0), (U.rules_table(df, U.RULES), 0)))
    want = sorted(map(str, by_map.collect()))
    assert sorted(map(str, by_join.collect())) == want == sorted(map(str, by_table.collect()))
    got = U.filter_urls(df, rules).collect()
    assert len(got) == len(rows) + 20
    fit: dict[str, list[U.Rule]] = {}
    for r in rules:
        fit.setdefault(r.tokens[-1], []).append(r)
    for r in got:
        url = parts(dict(rows)[r.page_id])
        tokens = set(re.split("[^a-z0-9]+", "".join(url).lower()))
        fits = [x for t in tokens for x in fit.get(t, ()) if re.search(x.pattern, "".join(url), re.S)]
        best = max(fits, key=lambda x: (x.rank, x.name), default=None)
        assert (r.rule, r.verdict) == (best.name if best and best.named else None, best.verdict if best else "allow"), url

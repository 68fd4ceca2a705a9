"""URL filters whose rules are indexed by their rarest literal token. DataFrame functions only.

A rule has a pattern over ``host || path`` and a priority. The literal tokens that every matching
URL must hold are known for each rule; the rule is filed under the one that is rarest in the URLs
at hand (counted over all rows). A URL's tokens fetch the rules filed under them, and only those
run their regular expression.

A short list of rules travels inside the plan as a map, and every row is judged on its own. A longer
one, or one that is a table, is joined: distinct URLs meet the index by token, and rows meet the verdict
of their URL. Both give the same result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules beyond this are joined as a table.
MAP_RULES = 500
RULE_SCHEMA = "name string, pattern string, verdict string, tokens array<string>, rank int, named boolean"

# Words that name what a host with one of them as a part of its name is for.
TOPICS = {
    "gambling": "bet bets betting bingo blackjack bookie bookmaker casino casinos gambling jackpot lotto lottery poker roulette slots sportsbook wager",
    "adult": "adult camgirls cams erotic escort escorts hentai nude nudes porn porno sex sexy xxx",
    "medicines": "cialis levitra meds pharma pharmacy pill pills steroids tramadol viagra weightloss xanax",
    "advertising": "ad ads adserver adserving advert adverts banner banners clickbait doubleclick popads popunder tracker trackers tracking",
    "spam": "backlink backlinks linkfarm phishing scam seolinks spam spammer spamming",
    "malware": "crack cracks keygen malware ransomware trojan warez",
    "fraud": "counterfeit fakeid payday replica replicas",
}


@dataclass(frozen=True)
class Rule:
    """``name`` is what is reported, ``pattern`` a regular expression over ``host || path``.

    ``tokens``: maximal alphanumeric runs, in lower case, that stand whole in every match. ``rank``: the rule
    with the largest (rank, name) among those that match gives the verdict; ``named``: whether
    the rule's name is reported.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int
    named: bool = True


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and all its subdomains if the path starts with ``path``; the longer rule wins."""
    parts = re.findall(r"[A-Za-z0-9]+", host)
    # The last run of the path may go on in the URL, so it is no whole token unless something ends it.
    parts += re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), verdict, tuple(x.lower() for x in parts), 1000 + len(host + path))


def topic_rule(verdict: str, topic: str) -> Rule:
    """Fits hosts of which ``topic`` is a part between dots and hyphens, like ``free-bets.example.com`` for ``bets``."""
    return Rule(topic, r"^(?:[^/]*[.-])?" + re.escape(topic) + r"(?![^-.:/])", verdict, (topic,), 1, False)


RULES = (
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
    *(topic_rule("block", word) for words in TOPICS.values() for word in words.split()),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, {1} + 3)".format("url", "instr(url, '://')"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"))


def token_counts(parts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many rows hold each of the tokens; at most as many numbers come back, whatever the input's size."""
    held = parts.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, tokens)))).alias("token")) if tokens else None
    found = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if held is not None else {}
    return {t: found.get(t, 0) for t in tokens}


def rules_table(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table (``RULE_SCHEMA``), to be kept or filtered with."""
    return pages.sparkSession.createDataFrame([(r.name, r.pattern, r.verdict, list(r.tokens), r.rank, r.named) for r in rules], RULE_SCHEMA)


_BEST = ["rank", "name", "pattern", "verdict", "named"]


def _by_map(parts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``parts`` with ``best``: rules from a map in the plan, no shuffle."""
    counts = token_counts(parts, sorted({t for r in rules for t in r.tokens}))
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(r)

    def entry(r: Rule) -> Column:
        return F.struct(*(F.lit(getattr(r, name)).alias(name) for name in _BEST))

    index = F.create_map(*[x for t, rs in filed.items() for x in (F.lit(t), F.array(*map(entry, rs)))])
    fetched = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    return parts.withColumn("best", F.array_max(F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))))


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``parts`` with ``best``: distinct URLs are joined with the index of the rules by token."""
    urls = parts.select("host", "path", "tokens").dropDuplicates(["host", "path"])
    held = urls.select("host", "path", F.explode("tokens").alias("token"))
    literal = rules.select(*_BEST, F.explode("tokens").alias("token"))
    n = parts.select(F.explode("tokens").alias("token")).join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("token", F.struct("n", "token")).alias("token")
    index = literal.join(n, "token", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy(*_BEST).agg(rarest)
    fits = held.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(F.max(F.struct(*_BEST)).alias("best"))
    return parts.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = "allow", map_rules: int = MAP_RULES) -> DataFrame:
    """Judge ``pages.url``: page_id, host, path, rule, verdict for each row, repeated rows included.

    ``rules``: rules, or a table of them (``RULE_SCHEMA``; one without tokens never fits). ``rule`` is the
    name of the winning named rule, else null; ``verdict`` is that of the best matching rule of any kind,
    else ``default``. Other columns of ``pages`` are not read; a null page_id is passed on; an empty table
    gives no rows, and a long URL is matched as a whole.
    """
    listed = not isinstance(rules, DataFrame)
    if listed and any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    if listed and not rules:
        out = parts.withColumn("best", F.lit(None).cast("struct<rank:int,name:string,pattern:string,verdict:string,named:boolean>"))
    elif listed and len(rules) <= map_rules:
        out = _by_map(parts, rules)
    else:
        out = _by_join(parts, rules_table(pages, rules) if listed else rules)
    return out.select("page_id", "host", "path", F.when(F.col("best.named"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

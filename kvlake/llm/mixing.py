"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. A parent's token budget goes to its children in proportion to
their weights; a child that holds less than its share gives the rest to its siblings, and only what
a whole family can't hold is left to the parent's siblings: since a node's capacity is the sum of its
leaves', filling each family from the top down does both. A leaf's budget is so many whole epochs
and then the prefix of the next one in a seeded order.

The seeded order is never sorted as a whole: hash buckets of bounded size get running token sums, and
only the bucket in which a leaf's budget ends is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, free_name

LEAF = ["domain", "lang", "source"]
#: Rows of a hash bucket, about; a leaf has at most 65,536 buckets.
BUCKET_ROWS = 1024
_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Plan:
    """``domains``: source to domain, others are ``other``; ``weights``: node name to whole weight, 1 where none is given, 0 for nothing.

    ``percent``: the budget as a share of all tokens; ``max_epochs``: how often a row may be taken.
    """

    domains: Mapping[str, str] = field(default_factory=dict)
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17


PRODUCTION = Plan(
    domains={"src0": "crawl", **{f"src{i}": "books" for i in range(1, 7)}, **{f"src{i}": "forum" for i in range(7, 13)}},
    domain_weights={"crawl": 3, "books": 4, "forum": 2, "other": 1},
    lang_weights={"en": 6, "de": 2},
    source_weights={"src1": 3},
)


def _looked_up(names: Mapping, key: Column, default) -> Column:
    out = F.lit(default)
    for name, value in names.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Split each parent's ``budget`` over its children (``weight`` > 0, ``cap``): replaces ``budget`` by the child's.

    Water-filling in whole numbers: in the order of cap / weight a child is full if its cap is no
    more than its share of what those before it left over.
    """
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), key)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_BIG)
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(18,0)")
    c = children.withColumn("before", before).withColumn("onward", onward)
    c = c.withColumn("full", F.col("cap").cast("decimal(20,0)") * F.col("onward") <= (F.col("budget").cast("decimal(20,0)") - F.col("before").cast("decimal(20,0)")) * F.col("weight").cast("decimal(18,0)"))
    c = c.withColumn("held", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)).cast("long"))
    c = c.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(family).cast("long"))
    share = F.expr("cast((cast(budget - held as decimal(20,0)) * cast(weight as decimal(18,0))) div cast(open as decimal(18,0)) as bigint)")
    return c.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("before", "onward", "full", "held", "open")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Add ``budget`` to leaves (domain, lang, source, tokens, n); leaves of no weight are left out."""
    weighted = (
        leaves.withColumn("w_domain", _looked_up(plan.domain_weights, F.col("domain"), 1).cast("long"))
        .withColumn("w_lang", _looked_up(plan.lang_weights, F.col("lang"), 1).cast("long"))
        .withColumn("w_source", _looked_up(plan.source_weights, F.col("source"), 1).cast("long"))
    )
    total = leaves.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {plan.percent} div 100 as bigint)").alias("budget"))
    usable = weighted.where("w_domain > 0 and w_lang > 0 and w_source > 0").withColumn("cap", F.col("tokens") * plan.max_epochs)
    domains = usable.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w_domain").alias("weight"))
    # One row of one number, whatever the input: the only join without a key.
    domains = fill(domains.crossJoin(F.broadcast(total)), [], "domain").select("domain", "budget")
    langs = usable.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.first("w_lang").alias("weight"))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    return fill(usable.withColumnRenamed("w_source", "weight").join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "n", "budget")


def select(docs: DataFrame, plan: Plan = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: each row taken, once for each epoch that takes it.

    A null language or source counts as ''. A null or empty text has no tokens; such rows come with
    the epochs that reach them and cost nothing, but a (domain, lang, source) without any token has
    no budget and gives no rows. Rows that repeat a doc_id or have none are taken one by one. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    return _taken(docs, plan)


def _taken(docs: DataFrame, plan: Plan, tokenless: bool = False, marks: Sequence[str] = ()) -> DataFrame:
    """``select``; ``tokenless``: whether leaves without any token come with all epochs; ``marks``: columns that tell rows of one id apart, handed on."""
    d = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        token_count(F.col("text")).alias("n_tokens"),
        *marks,
    )
    d = cut(d.withColumn("domain", _looked_up(plan.domains, F.col("source"), "other")))
    leaves = d.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    b = budgets(leaves, plan).where("tokens = 0 or budget > 0" if tokenless else "budget > 0 and tokens > 0")
    b = b.withColumn("whole", F.expr(f"if(tokens = 0, {plan.max_epochs}L, budget div nullif(tokens, 0))")).withColumn("rest", F.expr("if(tokens = 0, 0L, budget % nullif(tokens, 0))"))
    b = cut(b.withColumn("buckets", F.expr(f"least(65536, n div {BUCKET_ROWS} + 1)")))
    rows = d.join(b.drop("tokens", "n", "budget"), LEAF)
    key = F.md5(F.concat_ws("|", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bucket", F.expr("cast(conv(substr(key, 1, 4), 16, 10) as bigint) * buckets div 65536"))
    out = ["doc_id", *LEAF, "n_tokens", *marks]
    whole = rows.where("whole > 0").select(*out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    last = rows.where("rest > 0")
    sums = last.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).where("upto - in_bucket <= rest").select(*LEAF, "bucket", (F.col("upto") - F.col("in_bucket")).alias("passed"), (F.col("upto") <= F.col("rest")).alias("all"))
    met = last.join(sums, [*LEAF, "bucket"])
    inside = met.where("all").select(*out, F.col("whole").alias("epoch"))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key", "doc_id", "n_tokens", *marks).rowsBetween(Window.unboundedPreceding, 0))
    edge = met.where("not all").withColumn("run", run).where("passed + run <= rest").select(*out, F.col("whole").alias("epoch"))
    return whole.unionByName(inside).unionByName(edge)


def keep_selected(docs: DataFrame, plan: Plan, unnamed: bool = False) -> DataFrame:
    """The rows of ``docs`` that one epoch takes; the columns stay as they are.

    Rows are taken one by one, those that repeat a doc_id too: of rows that are alike in all columns as many
    stay as were taken. Rows without a doc_id have their part of the budget; they are taken like any other if
    ``unnamed``, else not at all. Rows whose (domain, lang, source) has no token cost nothing and stay, unless
    a weight is 0. An empty table gives no rows.
    """
    if plan.max_epochs != 1:
        raise ValueError("rows are kept or not: max_epochs must be 1")
    marks = [free_name(f"mark{i}", docs.columns) for i in (1, 2)]
    rows = docs.withColumns({name: F.xxhash64(F.lit(i), *(F.col(f"`{c}`") for c in docs.columns)) for i, name in enumerate(marks)})
    taken = _taken(rows, plan, True, marks).select(F.col("doc_id").alias("t_id"), *(F.col(m).alias(f"t_{m}") for m in marks))
    taken = taken.where(F.lit(True) if unnamed else F.col("t_id").isNotNull()).groupBy(taken.columns).agg(F.count(F.lit(1)).alias("t_times"))
    taken = cut(taken)
    often = rows.groupBy("doc_id", *marks).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    often = cut(often.select(F.col("doc_id").alias("o_id"), *(F.col(m).alias(f"o_{m}") for m in marks)))

    def same(side: str) -> Column:
        parts = [F.col(m) == F.col(f"{side}_{m}") for m in marks]
        return F.col("doc_id").eqNullSafe(F.col(f"{side}_id")) & parts[0] & parts[1]

    kept = rows.join(taken.drop("t_times"), same("t"), "left_semi")
    if often.isEmpty():
        return kept.select(docs.columns)
    alike = kept.join(often, same("o"), "left_semi").groupBy("doc_id", *marks).agg(F.first(F.struct(*docs.columns)).alias("alike"))
    again = alike.join(taken, same("t")).select("alike", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t_times")))).select("alike.*")
    return kept.join(often, same("o"), "left_anti").select(docs.columns).unionByName(again)

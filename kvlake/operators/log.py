"""The log: batches, sequence numbers, and exactly-once application of client commands.

Sequence numbers are global, so they come from a running sum over batch headers. The sum is made in
two steps: totals of ranges of batches, a running sum of those few totals, and sums within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.model import DELETE, MAX_BATCH_BYTES, PUT, RESERVED_PREFIX
from kvlake.plans.lineage import cut

#: Log positions summed up together before the global running sum.
RANGE = 1 << 16


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """``out`` = sum of ``amount`` over all rows with a smaller ``order`` (a non-negative BIGINT): no single task sees all rows."""
    return running_totals(df, order, {amount: out})


def running_totals(df: DataFrame, order: str, amounts: dict[str, str]) -> DataFrame:
    """The running totals of several amounts, each under the name given for it, in one pass."""
    ranged = df.withColumn("_range", F.expr(f"{order} div {RANGE}"))
    totals = ranged.groupBy("_range").agg(*(F.sum(amount).alias(f"_sum_{out}") for amount, out in amounts.items()))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = {out: F.coalesce(F.sum(f"_sum_{out}").over(upto(Window.orderBy("_range"))), F.lit(0)) for out in amounts.values()}
    totals = totals.select("_range", *(c.alias(f"_before_{out}") for out, c in before.items()))
    within = {f"_within_{out}": F.coalesce(F.sum(amount).over(upto(Window.partitionBy("_range").orderBy(order))), F.lit(0)) for amount, out in amounts.items()}
    met = ranged.withColumns(within).join(totals, "_range")
    met = met.withColumns({out: (F.col(f"_before_{out}") + F.col(f"_within_{out}")).cast("long") for out in amounts.values()})
    return met.drop("_range", *within, *(f"_before_{out}" for out in amounts.values()))


def number_by_key(rows: DataFrame, next_seq: int) -> DataFrame:
    """Add ``seq``, from ``next_seq`` on in key order, and ``total``, the number of rows. Keys are dealt in ranges, counted, and numbered within."""
    dealt = cut(rows.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    ends = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_of", F.coalesce(F.sum("_n").over(ends), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1
    met = dealt.withColumn("_nth", nth).join(counts, F.col("_part") == F.col("_of"))
    return met.withColumn("seq", (F.col("_before") + F.col("_nth") + next_seq).cast("long")).drop("_part", "_of", "_before", "_nth")


def put(seq: Column, key: Column, value: Column) -> list[Column]:
    """Columns of a put; a null value is an empty one."""
    return [seq.alias("seq"), key.alias("key"), F.lit(PUT).cast("tinyint").alias("kind"), F.coalesce(value, F.lit(b"")).alias("value")]


def delete(seq: Column, key: Column) -> list[Column]:
    """Columns of a tombstone; the key need not exist."""
    return [seq.alias("seq"), key.alias("key"), F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("value")]


def _number_bytes(n: Column) -> Column:
    """Bytes of a base-128 number below 2**35."""
    return F.lit(1) + sum((n >= 1 << 7 * i).cast("int") for i in range(1, 5))


def encoded_bytes(ops: Column) -> Column:
    """Bytes of an encoded batch: sequence number and count, and for each op its kind, sized key and, if it is a put, sized value."""

    def size(op: Column) -> Column:
        key, value = F.octet_length(op["key"]), F.coalesce(F.octet_length(op["value"]), F.lit(0))
        return 1 + _number_bytes(key) + key + F.when(op["kind"] == PUT, _number_bytes(value) + value).otherwise(0)

    return F.aggregate(ops, (8 + _number_bytes(F.size(ops))).cast("long"), lambda n, op: n + size(op))


def batch_faults(batches: DataFrame, most_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Add ``fault``: why a batch is refused as a whole (too_large, reserved_key, bad_kind, bad_value), or null."""
    fault = (
        F.when(encoded_bytes(F.col("ops")) > most_bytes, F.lit("too_large"))
        .when(F.exists("ops", lambda op: F.startswith(op["key"], F.lit(RESERVED_PREFIX))), F.lit("reserved_key"))
        .when(F.exists("ops", lambda op: ~op["kind"].isin(DELETE, PUT)), F.lit("bad_kind"))
        .when(F.exists("ops", lambda op: (op["kind"] == DELETE) & op["value"].isNotNull()), F.lit("bad_value"))
    )
    return batches.withColumn("fault", fault)


def number_batches(batches: DataFrame) -> DataFrame:
    """Add ``n_ops`` and ``base_seq``, the first op's sequence number; the log starts at 1 and empty batches take none."""
    sized = batches.withColumn("n_ops", F.coalesce(F.size("ops"), F.lit(0)).cast("long"))
    return running_total(sized, "batch_id", "n_ops", "_taken").withColumn("base_seq", F.col("_taken") + 1).drop("_taken")


def explode_batches(numbered: DataFrame) -> DataFrame:
    """(batch_id, seq, key, kind, value) of each op; a put without a value stores an empty one."""
    rows = numbered.select("batch_id", "base_seq", F.posexplode("ops").alias("at", "op"))
    value = F.when(F.col("op.kind") == PUT, F.coalesce("op.value", F.lit(b"")))
    return rows.select("batch_id", (F.col("base_seq") + F.col("at")).alias("seq"), "op.key", "op.kind", value.alias("value"))


def last_in_batch(exploded: DataFrame) -> DataFrame:
    """Of several ops on one key in a batch the last one counts."""
    w = Window.partitionBy("batch_id", "key").orderBy(F.desc("seq"))
    return exploded.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def mark_applied(commands: DataFrame) -> DataFrame:
    """Add ``applied``: a client's command applies if its number is above all before; a negative client id turns that off.

    The high-water mark runs over ranges of the log first, so that one client's commands are summed
    up by many tasks.
    """
    ranged = commands.withColumn("_range", F.expr(f"log_index div {RANGE}"))
    tops = ranged.groupBy("client_id", "_range").agg(F.max("client_seq").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("client_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("client_id").alias("_client"), F.col("_range").alias("_of"), before.alias("_before"))
    within = F.max("client_seq").over(Window.partitionBy("client_id", "_range").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1))
    met = ranged.withColumn("_within", within).join(tops, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("_range") == F.col("_of")))
    mark = F.greatest(F.coalesce("_before", F.lit(0)), F.coalesce("_within", F.lit(0)))
    applied = F.coalesce((F.col("client_id") < 0) | (F.col("client_seq") > mark), F.lit(False))
    return met.withColumn("applied", applied).drop("_range", "_within", "_before", "_client", "_of")


def session_table(marked: DataFrame) -> DataFrame:
    """Highest applied command of each client that takes part."""
    return marked.where("applied and client_id >= 0").groupBy("client_id").agg(F.max("client_seq").alias("client_seq"))


def consumed_seqs(marked: DataFrame) -> DataFrame:
    """Engine sequence numbers of each log entry: its ops if applied, a session row if deduplicated, and one bookkeeping row."""
    ops = F.when(F.col("applied"), F.coalesce(F.size("ops"), F.lit(0))).otherwise(0)
    session = F.when(F.col("applied") & (F.col("client_id") >= 0), 1).otherwise(0)
    counted = marked.withColumn("n_seqs", (ops + session + 1).cast("long"))
    return running_total(counted, "log_index", "n_seqs", "_taken").withColumn("base_seq", F.col("_taken") + 1).drop("_taken")


def applied_ops(marked: DataFrame) -> DataFrame:
    """The ops that a log of commands makes, in sequence; entries without ops only move the index on."""
    taken = marked.where("applied and ops is not null").select(F.col("log_index").alias("batch_id"), "ops")
    return explode_batches(number_batches(taken))


def log_gaps(entries: DataFrame) -> DataFrame:
    """Entries that don't follow their predecessor by one: log_index, previous_index. Ends of ranges meet in a second step."""
    ranged = entries.select("log_index", F.expr(f"log_index div {RANGE}").alias("_range"))
    inner = ranged.withColumn("previous_index", F.lag("log_index").over(Window.partitionBy("_range").orderBy("log_index")))
    ends = ranged.groupBy("_range").agg(F.min("log_index").alias("log_index"), F.max("log_index").alias("_last"))
    outer = ends.withColumn("previous_index", F.lag("_last").over(Window.orderBy("_range")))
    both = inner.where("previous_index is not null").select("log_index", "previous_index").unionByName(outer.where("previous_index is not null").select("log_index", "previous_index"))
    return both.where("log_index <> previous_index + 1")


def snapshot_meta(entries: DataFrame) -> DataFrame:
    """Index and term of the newest entry."""
    return entries.agg(F.max("log_index").alias("log_index"), F.max_by("term", "log_index").alias("term"))


def entries_after(entries: DataFrame, index: int) -> DataFrame:
    """What is left of a log once a snapshot at ``index`` stands in for the rest."""
    return entries.where(F.col("log_index") > index)

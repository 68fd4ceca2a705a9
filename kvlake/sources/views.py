"""Key-value views of the relational tables: logs, batches, commands and histories to query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.model import DELETE, PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def user_key(user_id: Column) -> Column:
    return F.concat(F.lit("user:"), _padded(user_id, 8)).cast("binary")


def ops_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One op for each event, in order: an error deletes the user's pair, any other event sets it."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        user_key(F.col("user_id")).alias("key"),
        F.when(error, DELETE).otherwise(PUT).cast("tinyint").alias("kind"),
        F.when(~error, F.coalesce("props", F.lit(""))).cast("binary").alias("value"),
    )


def line_key(order: Column, number: Column) -> Column:
    return F.concat(F.lit("order/"), _padded(order, 12), F.lit("/line/"), _padded(number, 2)).cast("binary")


def batches_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch for each order, its lines in a total order of their columns; line numbers may repeat."""
    item = F.struct(
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_quantity")).cast("long").alias("quantity"),
    )
    op = lambda x: F.struct(
        F.when(x["quantity"] % 10 == 0, DELETE).otherwise(PUT).cast("tinyint").alias("kind"),
        line_key(F.col("batch_id"), x["n"]).alias("key"),
        F.when(x["quantity"] % 10 != 0, F.concat_ws(":", x["part"].cast("string"), x["supp"].cast("string"), x["cents"].cast("string")).cast("binary")).alias("value"),
    )
    # An order has a handful of lines.
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("batch_id", F.transform("items", op).alias("ops"))


def pairs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live pairs (key, value) of orders."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), _padded(F.col("o_orderkey"), 12)).cast("binary").alias("key"), F.col("o_orderstatus").cast("binary").alias("value"))


def commands_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client commands: many repeat a number already applied; every 50th has a client id below zero, every 97th no ops."""
    e = table(spark, sf_dir, "events")
    client = F.when(F.col("event_id") % 50 == 49, -1 - F.col("user_id")).otherwise(F.col("user_id"))
    op = F.struct(F.lit(PUT).cast("tinyint").alias("kind"), user_key(F.col("user_id")).alias("key"), F.coalesce("props", F.lit("")).cast("binary").alias("value"))
    return e.select(
        (F.col("event_id") + 1).alias("log_index"),
        (F.floor(F.col("event_id") / 1000) + 1).cast("long").alias("term"),
        F.lit(0).cast("tinyint").alias("entry_type"),
        client.alias("client_id"),
        F.floor("value").cast("long").alias("client_seq"),
        F.when(F.col("event_id") % 97 != 96, F.array(op)).alias("ops"),
    )


def placed_ops(spark: SparkSession, sf_dir: str, groups: list[int]) -> DataFrame:
    """The event ops where an even hash of users put them, and each seventh user's a second time in the next group."""
    ops = ops_from_events(spark, sf_dir).withColumn("user", F.expr("cast(substr(cast(key as string), 6) as bigint)"))
    lists = F.array(*[F.lit(g).cast("long") for g in groups])
    home = F.element_at(lists, (F.col("user") % len(groups)).cast("int") + 1)
    stray = ops.where("user % 7 = 0").withColumn("group_id", F.element_at(lists, ((F.col("user") + 1) % len(groups)).cast("int") + 1))
    return ops.withColumn("group_id", home).unionByName(stray).select("group_id", "seq", "key", "kind", "value")


def files_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list: customers' orders in key order, a file for each thousand keys and level, levels overlapping."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("level"), F.expr("o_orderkey div 1000").alias("part"))
    name = F.concat(F.lit("order/"), _padded(F.col("o_orderkey"), 12)).cast("binary")
    return (
        o.groupBy("level", "part")
        .agg((F.count(F.lit(1)) * 100_000).alias("size"), F.min(name).alias("smallest"), F.max(name).alias("largest"))
        .select("level", (F.col("part") * 10 + F.col("level")).alias("file_num"), "size", "smallest", "largest")
    )


def edits_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest edits: every file is added, every third is deleted later, every ninth added again."""
    files = files_from_orders(spark, sf_dir)
    rows = [("add", 0, "true"), ("delete", 100_000_000, "file_num % 3 = 0"), ("add", 200_000_000, "file_num % 9 = 0")]
    parts = [files.where(cond).withColumn("edit_id", F.col("file_num") + at).withColumn("action", F.lit(action)) for action, at, cond in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def history_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of write-once keys and reads of the same keys, some of which see nothing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("wait"), "event_type")
    key = F.concat(F.lit("w"), F.expr("event_id div 2").cast("string")).cast("binary")
    put = F.col("event_id") % 2 == 0
    seen = F.when(put | (F.col("user_id") % 5 != 0), F.concat(F.lit("v"), F.expr("event_id div 2").cast("string"))).cast("binary")
    return e.select(
        F.col("event_id").alias("op_id"),
        F.when(put, "put").otherwise("get").alias("op"),
        key.alias("key"),
        seen.alias("value"),
        (F.col("event_id") * 10).alias("start_ts"),
        (F.col("event_id") * 10 + F.col("wait") % 25).alias("end_ts"),
        (F.col("event_type") != "error").alias("ok"),
    )

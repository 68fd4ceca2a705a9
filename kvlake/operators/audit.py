"""Audits of histories, replicas and committed logs. Consensus itself is input, not run here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose value differs between two states (key, value): key, value_a, value_b."""
    left = a.select("key", F.col("value").alias("value_a"))
    right = b.select("key", F.col("value").alias("value_b"))
    return left.join(right, "key", "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def stale_reads(history: DataFrame) -> DataFrame:
    """Reads that start after an acknowledged write of their (write-once) key ended and return something else: op_id, key.

    A key is written once, so each key has one row of writes and reads meet it by key.
    """
    acked = history.where("op = 'put' and ok").groupBy("key").agg(F.min("end_ts").alias("acked_at"), F.min_by("value", "end_ts").alias("written"))
    reads = history.where("op = 'get' and ok").select("op_id", "key", F.col("value").alias("seen"), "start_ts")
    return reads.join(acked, "key").where((F.col("start_ts") > F.col("acked_at")) & ~F.col("seen").eqNullSafe(F.col("written"))).select("op_id", "key")


def lost_acks(history: DataFrame, state: DataFrame) -> DataFrame:
    """Acknowledged writes of write-once keys that the final state lacks or holds otherwise: key."""
    acked = history.where("op = 'put' and ok").groupBy("key").agg(F.min_by("value", "end_ts").alias("written"))
    held = state.select("key", F.col("value").alias("held"))
    return acked.join(held, "key", "left").where(~F.col("written").eqNullSafe(F.col("held"))).select("key")


def split_terms(events: DataFrame) -> DataFrame:
    """Terms with more than one leader: term, leaders."""
    return events.groupBy("term").agg(F.count_distinct("leader").alias("leaders")).where("leaders > 1")


def log_conflicts(entries: DataFrame) -> DataFrame:
    """Committed indexes at which nodes disagree: log_index, variants. ``entries``: node, log_index, term, data."""
    return entries.groupBy("log_index").agg(F.count_distinct(F.struct("term", "data")).alias("variants")).where("variants > 1")


def membership(changes: DataFrame) -> DataFrame:
    """Current members from a log of changes (log_index, node, action add, add_learner or remove): the last one counts."""
    w = Window.partitionBy("node").orderBy(F.desc("log_index"))
    last = changes.withColumn("_nth", F.row_number().over(w)).where("_nth = 1 and action <> 'remove'")
    return last.select("node", F.when(F.col("action") == "add", "voter").otherwise("learner").alias("role"))


def quorum_index(matches: DataFrame, by: list[str]) -> DataFrame:
    """The index that a majority of voters has reached, by group: the k-th largest, k = n div 2 + 1."""
    # A group's voters are a few nodes, whatever the data.
    ranked = F.sort_array(F.collect_list("match_index"), asc=False)
    return matches.groupBy(*by).agg(F.element_at(ranked, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("commit_index"))


def commit_index(matches: DataFrame, entries: DataFrame, leaders: DataFrame) -> DataFrame:
    """group_id and commit_index: what a majority has reached, if that entry is of the leader's own term, else what was committed.

    ``matches``: group_id, match_index of each voter; ``entries``: group_id, log_index, term; ``leaders``: group_id, term, committed.
    """
    reached = quorum_index(matches, ["group_id"]).withColumnRenamed("commit_index", "reached")
    terms = entries.select("group_id", F.col("log_index").alias("reached"), F.col("term").alias("entry_term"))
    met = leaders.join(reached, "group_id", "left").join(terms, ["group_id", "reached"], "left")
    forward = (F.col("reached") > F.col("committed")) & (F.col("entry_term") == F.col("term"))
    return met.select("group_id", F.when(forward, F.col("reached")).otherwise(F.col("committed")).alias("commit_index"))


def double_votes(votes: DataFrame) -> DataFrame:
    """Nodes that voted for more than one candidate in a term: node, term, candidates. ``votes``: node, term, candidate."""
    return votes.groupBy("node", "term").agg(F.count_distinct("candidate").alias("candidates")).where("candidates > 1")


def overlapping_changes(changes: DataFrame) -> DataFrame:
    """Changes of members that were proposed while the one before was not applied: group_id, log_index, previous_index.

    ``changes``: group_id, log_index, applied (the index applied when it was proposed). A group has few changes.
    """
    w = Window.partitionBy("group_id").orderBy("log_index")
    seen = changes.withColumn("previous_index", F.lag("log_index").over(w))
    return seen.where("previous_index > applied").select("group_id", "log_index", "previous_index")


def reached_epoch(nodes: DataFrame, epoch: int) -> DataFrame:
    """How many nodes hold the map of an epoch or a later one."""
    return nodes.agg(F.count_if(F.col("epoch") >= epoch).alias("reached"), F.count(F.lit(1)).alias("nodes"))

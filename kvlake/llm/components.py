"""Connected components of links held as a DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._spark import cut, spend


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.unionByName(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contracted(links: DataFrame) -> DataFrame:
    """One round of contraction: links (a < b) that join the same nodes, most of them to the smallest node of their component."""
    return cut(_small_star(_large_star(_edges(links))))


def part_labels(links: DataFrame) -> DataFrame:
    """(node, component) by the smallest linked node: nodes of one label are joined, but a component may have several labels."""
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the component is its smallest node.

    Rounds go on until the links are stars around the smallest nodes: a number that grows with the
    logarithm of the longest chain. Each round's links are written to the shared checkpoint folder;
    only three sums reach the driver, counted while they are written. Links with a null end or to the
    node itself say nothing.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")))
        return out, tuple(seen.get.values())

    edges, now = written(_edges(links))
    while now[0]:
        before, old = now, edges
        edges, now = written(_small_star(_large_star(old)))
        spend(old)
        if before == now:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

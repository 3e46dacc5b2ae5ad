"""Connected components of a link table, by alternating large and small stars over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrat.session import spent, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the node's smallest neighbour or itself."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a stored table, with their number and the sum of their hashes, seen while writing."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    out = stored(counted, "links")
    return out, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): one row (a, b) per node that is not the smallest of its component, b being the smallest.

    Rows a = b and repeated rows are allowed. Every round is written, and joined on nodes, so a node with very many links
    is no single task: its rows are combined before the shuffle and large join partitions are split.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, state = _written(now)
    while state[0]:
        before = now
        now, after = _written(_small_star(_large_star(before).distinct()).distinct())
        spent(before)
        if after == state:
            break
        state = after
    return now

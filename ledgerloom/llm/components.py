"""Connected components of a graph given as edges, in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of each node in edges (a, b); the component is its smallest node.

    Every round rewrites the edges: large stars hang a node's greater neighbours on the smallest of its neighbourhood,
    small stars its smaller ones. Rounds grow with the logarithm of the graph. The edges of a round are written to the
    shared folder; a node with many neighbours costs one partial minimum a task and a join that Spark can split."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small stars: every edge points down here
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(down.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

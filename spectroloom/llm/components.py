"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and an equi-join, until
    the edges are stars around each component's smallest node, which one aggregation per round tells. Loops, repeated and null edges are
    allowed and add nothing; nodes without an edge to another node are not returned. Every round is
    checkpointed in the shared folder, so its lineage stays short.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u != v").distinct()
    pairs = checkpointed(pairs)
    for _ in range(max_rounds):
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        pairs = checkpointed(small)
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("arms")).unionAll(pairs.select("v", F.lit(0)))
        open_ends = ends.groupBy("node").agg(F.sum("arms").alias("arms"), F.min("arms").alias("least")).where("arms > 1 or arms = 1 and least = 0")
        if open_ends.limit(1).count() == 0:  # no node has two centres, or is an arm and a centre
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

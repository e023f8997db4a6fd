"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that edges (u, v) reach, for every node of an edge.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its
    smallest one, then its smaller neighbours and itself to it. Each round is written to the shared
    folder. Minima are pre-aggregated, and the joins put nothing together by key above them, so
    a node with very many edges can be split. Loops and repeated edges are allowed.
    """
    pairs = stage_table(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(low, "u")
        small = tied.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        after = stage_table(small.distinct(), "edges")
        # Stars with their least node in the middle are the end: each node has one edge and no
        # node is on both sides.
        sides = after.select("u", F.lit(1).alias("n")).union(after.select("v", F.lit(0)).distinct().select("v", F.lit(1)))
        done = sides.groupBy("u").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty()
        drop_table(pairs)
        pairs = after
        if done:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())

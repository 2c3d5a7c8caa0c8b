"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import shared_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a, b``, longs); ``root`` is the least node reached.

    Each round joins every node's larger neighbours to its least neighbour (large star), then every
    node's smaller neighbours (small star); rounds are cut with checkpoints and end when nothing changes.
    """
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edge = shared_checkpoint(edge)
    before = None
    while True:
        state = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(state)
        both = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edge.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edge = shared_checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())

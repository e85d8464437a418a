"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b) that isn't a root itself.

    Loops and repeats are ignored. Each step groups by minimum only, never gathers a node's
    neighbours, and is written to the shared folder; the steps end when the edges are stars.
    """

    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """The edges and, told while they are written, their number and the sum of their hashes."""
        told = Observation()
        out = cut(e.observe(told, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("code")), "edges")
        return out, told.get

    now, seen = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while seen["n"]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now, after = written(small.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        if after == seen:
            break
        seen = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): for each node of edges (a, b), the smallest node it can reach. Nodes without edges aren't listed.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node hands its larger, then its smaller
    neighbours to the smallest one it knows, until only stars are left, in a number of rounds that grows with the
    logarithm of the longest path. Minima are combined before shuffles, so a node with many edges is no bottleneck.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, f"{name}-0")
    for k in count(1):  # to the end, however many rounds it takes
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select("b", "m").where("b <> m").distinct()
        # Now (b, m) with m < b: b's smaller neighbours go to the least of them.
        least = large.groupBy("b").agg(F.min("m").alias("c"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("b"), F.col("c").alias("a")).unionByName(least.select("b", F.col("c").alias("a")))
        new = scratch.table(small.where("a <> b").select("a", "b").distinct(), f"{name}-{k}")
        tally = lambda e: e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        done = tally(new) == tally(edges)
        scratch.drop(f"{name}-{k - 1}")
        edges = new
        if done:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

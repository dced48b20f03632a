"""Connected components of an edge table by alternating large-star and small-star.

In a large-star step every node sends its larger neighbours to the least node
it knows; in a small-star step it sends its smaller neighbours and itself there.
Both are one aggregation (minimum, combined before the shuffle) and one join, in
which a hot node's edges are dealt in slices; no neighbour list is built.
When a round changes nothing, every node has one edge, to its component's least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import cut_narrow
from memloom.llm.skew import join_hot


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    sent = join_hot(both.filter("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", "v", least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return sent.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    sent = join_hot(down, least.select("u", "m"), "u", "v", least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return sent.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (node, component), the component's least node, for every node with an edge.

    Loops and edges with a null end are left out. Raises if `rounds` rounds do
    not settle the graph; a graph of n nodes needs about log2(n)**2 at worst.
    """
    now = cut_narrow(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        now = cut_narrow(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.operators.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: every larger neighbour of a node is linked to the least of its neighbourhood.
    Small: every node and its smaller neighbours are linked to the least of them.
    Minima are added up inside each task first, and the join leaves a hot node's rows apart.
    """
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        pairs = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return pairs.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of each component; nodes without links are absent.

    Every step is written to the shared folder; steps grow with the logarithm of the longest
    chain. The test for the end looks at a count and a checksum, never at the links.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stage(links.select(high.alias("u"), low.alias("v")).where("u != v").distinct(), "links").df
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).head()
        if state == before or not state["n"]:
            break
        before = state
        edges = stage(_star(_star(edges, True), False), "links").df
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())

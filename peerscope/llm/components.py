"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the smallest of them. edges(u, v) with u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b), component being the smallest node reachable.

    A step groups by node with partial aggregation and joins back, so a node with very many links is split as any
    skewed join key. Each pair of steps is cut into the checkpoint folder; the number of pairs grows with the logarithm
    of the number of nodes. Reaching `most` raises, as a wrong answer would be worse.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    sign = None
    for _ in range(most):
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        sign = now
    raise RuntimeError(f"components did not settle in {most} rounds")

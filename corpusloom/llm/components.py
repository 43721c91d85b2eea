"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FEW, frequent_from, split_join, stash


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges with m, the smallest neighbour of u; the nodes with a thousandth of all edges or more get theirs by broadcast."""
    if rows <= FEW:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")), "least")
    return split_join(edges, least, ["u"], frequent_from(rows))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both, 2 * rows).withColumn("m", F.least("u", "m"))
    return met.filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    met = _with_least(edges, rows)
    moved = met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.filter("v = m").select("u", "v")).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node but the roots.

    edges: columns u, v of one ordered type; loops and repeats do no harm. Each round is two
    aggregations with map-side combination and two joins that are split for the centres of large stars.
    The rounds needed grow with the logarithm of the largest component's diameter.
    """
    now = stash(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = _large_star(now, mark[0])
        now = stash(_small_star(large if mark[0] <= FEW else stash(large, "stars"), mark[0]), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

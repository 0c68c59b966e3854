"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b).

    Both stars replace each edge by one that points at a smaller node, so the table never grows beyond twice its
    edges; the number of rounds grows with the logarithm of the longest chain. Every round is checkpointed.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the smallest of the node and its neighbours. u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left")
    return joined.select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()

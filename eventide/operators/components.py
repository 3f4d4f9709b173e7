"""Connected components of an edge table by alternating star contractions.

Each round is two joins on node ids with map-side minima; the edge table never
leaves the cluster, and a node with very many edges is split by Spark's skew
handling like any join key. The number of rounds grows with the logarithm of
the longest path. Each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int | None]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]  # one row
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = cut_lineage(low)  # a plain shuffle on either side of the join, so that Spark may split a hot node
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    low = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, the component being its
    smallest node. ``edges`` has two long columns; loops and repeated edges
    are allowed."""
    a, b = (F.col(c) for c in edges.columns)
    now = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

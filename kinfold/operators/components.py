"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. ``edges`` point from u to a smaller v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars that share no node: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of the undirected graph ``edges(src, dst)`` as ``(node, component)``.

    ``component`` is the smallest node. Only nodes that have an edge to another node are returned; edges
    with a null end and self loops are ignored. Each round is a join and two aggregations with map-side
    combine, written to the shared folder, so neither edges nor components pass through the driver: joins
    are merge joins by hint, and it only learns whether stars are left that share a node. The number of
    rounds grows with the logarithm of the longest chain; edges that are stars already need none.
    """
    u, v = F.col(src), F.col(dst)
    e = materialize(edges.where((u < v) | (u > v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    rounds = 0
    while not _settled(e):
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        e = materialize(_small_star(_large_star(e)), "stars")
        rounds += 1
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

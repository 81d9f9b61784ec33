"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


#: Edges that one task takes; few edges go to few tasks, whatever the number of shuffle partitions.
EDGES = 200_000


def _broken(edges: DataFrame) -> tuple[int, int]:
    """Nodes that keep the edges from being stars around smallest nodes, and all nodes."""
    points = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("b").alias("y")))
    return tuple(points.groupBy("x").agg(F.min("y").alias("low"), F.max("y").alias("high")).agg(F.count_if(F.col("low") != F.col("high")), F.count("*")).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node it is connected with.

    Self-loops and repeated edges do no harm; nodes without an edge to another
    don't appear. Nothing is collected: a node with very many neighbours is
    joined with its smallest one, which Spark can split.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        broken, nodes = _broken(e)
        if not broken:
            break
        e = e.coalesce(8 + nodes // EDGES)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct().coalesce(8 + nodes // EDGES))
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), as a written table; root is one of the component's nodes.

    In each round every node points to the neighbour, or itself, that a hash of this round
    puts first; the edges between what is pointed at remain. A random order removes a
    constant share of the nodes, so rounds grow with the logarithm of the longest path.
    All state is in written tables; groups are only ever minima, never lists.
    """
    both = scratch.write(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct()
    rooted = scratch.write(nodes.select("node", F.col("node").alias("root")))
    turn = 0
    while not both.isEmpty():
        turn += 1
        # A node's first neighbour; itself if it comes before all of them.
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
        out = both.select(F.col("a").alias("at"), rank("b").alias("to")).union(both.select(F.col("b").alias("at"), rank("a").alias("to")))
        first = out.groupBy("at").agg(F.min("to").alias("to")).select("at", F.least("to", rank("at"))["id"].alias("to"))
        first = scratch.write(first)
        left = both.join(first.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(first.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        after = scratch.write(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(F.col("a") != F.col("b")).distinct())
        moved = scratch.write(rooted.join(first.select(F.col("at").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for old in (both, rooted, first):
            scratch.drop(old)
        both, rooted = after, moved
    scratch.drop(both)
    return rooted

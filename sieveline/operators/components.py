"""Connected components with the smallest member as the root."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b).

    Contraction in rounds: each node points at its first neighbour by a hash of the round,
    or at itself; edges between what is pointed at remain, so the number of rounds grows
    with the logarithm of the longest path. The state of a round is a written table in the
    shared checkpoint folder: lineage stays short and a lost executor costs no round.
    """
    spark = edges.sparkSession
    root, made = f"{shared_folder(spark)}/sieveline/components-{uuid.uuid4().hex}", iter(range(1 << 30))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(made)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    left = keep(edges.select("a", "b").where("a <> b").distinct())
    at = keep(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    turn = 0
    while not left.isEmpty():
        turn += 1
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = left.select("a", order("b").alias("to")).union(left.select(F.col("b").alias("a"), order("a").alias("to")))
        to = keep(both.groupBy("a").agg(F.min("to").alias("to")).select("a", F.least("to", order("a"))["id"].alias("to")))
        moved = left.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = keep(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        at = keep(at.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    least = at.groupBy("root").agg(F.min("node").alias("least"))
    return at.join(least, "root").select("node", F.col("least").alias("root"))

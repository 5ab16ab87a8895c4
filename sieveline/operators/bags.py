"""Bags: a query as the set of its relevant documents, with a centroid and a spread.

Centroids come from element-wise sums (see functions.vector): a group's vectors are never
gathered in one place, and spread follows from the length of the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V


def members(qrels: DataFrame, least: int = 2, cap: int = 50, smallest: int = 2) -> DataFrame:
    """(query_id, doc_id, grade, place): relevant documents by grade, for queries of enough of them, counted before the cap."""
    x = qrels.where(F.col("grade") >= least)
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("n") >= smallest)
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).where(F.col("place") <= cap).drop("n")


def describe(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, n, total, specificity): size, vector sum and mean cosine to the centroid."""
    s = V.sums(members.select("query_id", "doc_id").join(vectors.select("doc_id", "v"), "doc_id"), ["query_id"])
    return s.select("query_id", "n", "total", V.specificity(F.col("total"), F.col("n")).alias("specificity"))


def hard_negatives(run: DataFrame, positives: DataFrame, k: int = 10, skip: int = 0) -> DataFrame:
    """The first k of a run, from rank skip + 1 on, that are no positives."""
    left = run.where(F.col("rank") > skip).join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)


def triplets(qrels: DataFrame, positive, negative) -> DataFrame:
    """(query_id, positives, negatives): counts on both sides, for queries that have both."""
    return qrels.groupBy("query_id").agg(F.count_if(positive).alias("positives"), F.count_if(negative).alias("negatives")).where("positives > 0 AND negatives > 0")

"""Retrieval metrics over runs and graded judgments (qrels: query_id, doc_id, grade).

Each metric is one left join of judgments with a run on (query, document) and one
aggregation by query. Queries without relevant documents have no row, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["query_id", "doc_id"]


def judged(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """Judgments with the rank and score that the run gives them, if it does."""
    return qrels.join(run.select(*KEY, "rank", "score"), KEY, "left")


def recall(qrels: DataFrame, run: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(query_id, n_rel, n_hit, recall) over documents of at least this grade."""
    x = judged(qrels.where(F.col("grade") >= least), run)
    hits = F.count_if(F.col("rank") <= k)
    return x.groupBy("query_id").agg(F.count("*").alias("n_rel"), hits.alias("n_hit"), F.round(hits / F.count("*"), 6).alias("recall"))


def exact_at(qrels: DataFrame, run: DataFrame, j: int, top: int = 3) -> DataFrame:
    """(query_id, e): documents of the top grade in the first j over as many as could be there."""
    x = judged(qrels.where(F.col("grade") == top), run)
    return x.groupBy("query_id").agg(F.round(F.count_if(F.col("rank") <= j) / F.least(F.count("*"), F.lit(j)), 6).alias("e"))


def gain_of(gains: dict[int, float]) -> Column:
    return F.coalesce(*(F.when(F.col("grade") == g, F.lit(float(v))) for g, v in gains.items()), F.lit(0.0))


def ndcg(qrels: DataFrame, run: DataFrame, gains: dict[int, float], k: int = 10, ideal_least: int = 0) -> DataFrame:
    """(query_id, ndcg): Σ gain / log2(rank + 1) over the ideal order of judgments of at least `ideal_least`; null if that is 0."""
    x = judged(qrels, run).withColumn("gain", gain_of(gains))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "doc_id"))
    x = x.withColumn("best", F.when(F.col("grade") >= ideal_least, F.col("gain")).otherwise(0.0)).withColumn("place", place)
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    idcg = F.sum(F.when(F.col("place") <= k, F.col("best") / F.log2(F.col("place") + 1)).otherwise(0.0))
    return x.groupBy("query_id").agg(F.round(F.when(idcg > 0, dcg / idcg), 6).alias("ndcg"))


def pairwise(graded: DataFrame, higher: Column, lower: Column) -> DataFrame:
    """(query_id, concordance, n_pairs): how often an item of the higher kind outscores one of the lower; ties count half.

    graded: query_id, doc_id, grade, score. Ranks stand in for the pairs: a higher item
    beats as many lower ones as have a smaller score.
    """
    by = Window.partitionBy("query_id").orderBy("score")
    x = graded.where(higher | lower).withColumn("low", lower.cast("int")).withColumn("high", higher.cast("int"))
    below = F.sum("low").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("low").over(Window.partitionBy("query_id", "score"))
    x = x.withColumn("won", below - same / 2)
    pairs = F.sum("high") * F.sum("low")
    return x.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("high") == 1, F.col("won"))) / pairs, 6).alias("concordance"), pairs.alias("n_pairs")).where("n_pairs > 0")


def buckets(x: Column, upper: bool = True) -> Column:
    """Base-recall buckets; upper: whether one half belongs to the upper one."""
    low = x < 0.5 if upper else x <= 0.5
    return F.when(x == 0, "zero").when(x == 1, "one").when(low, "low").otherwise("high")

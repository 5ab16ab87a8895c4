"""Fusion of runs (query_id, doc_id, rank, score) into one ranking.

Runs are stacked and summed per (query, document): one aggregation in place of outer
joins, whatever the number of runs. Normalising windows stay within a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_query():
    return Window.partitionBy("query_id")


def stack(*runs: DataFrame) -> DataFrame:
    """All runs with `stream`, their number."""
    return reduce(DataFrame.unionByName, (r.select("query_id", "doc_id", "rank", "score", F.lit(i).alias("stream")) for i, r in enumerate(runs)))


def ranked(scored: DataFrame, k: int | None = None, digits: int = 6, up: bool = False) -> DataFrame:
    """With `rank` by the rounded score, ties by doc_id. up: the smallest first."""
    by = F.asc("score") if up else F.desc("score")
    out = scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(by_query().orderBy(by, "doc_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def rrf(*runs: DataFrame, constant: int = 60, first: int = 1) -> DataFrame:
    """Σ 1 / (constant + rank), ranks counted from `first`."""
    part = 1.0 / (constant + F.col("rank") - 1 + first)
    return stack(*runs).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def rank_sum(*runs: DataFrame, absent: int = 100) -> DataFrame:
    """Sum of ranks, small is good; a run without the document counts `absent`."""
    return stack(*runs).groupBy("query_id", "doc_id").agg((F.sum("rank") + absent * (len(runs) - F.count("*"))).cast("double").alias("score"))


def min_max(c: Column | str, eps: float = 1e-8) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    lo, hi = F.min(c).over(by_query()), F.max(c).over(by_query())
    return (c - lo) / F.greatest(hi - lo, F.lit(eps))


def z_score(c: Column | str) -> Column:
    """By the population's deviation; 0 where that is 0."""
    c = F.col(c) if isinstance(c, str) else c
    sd = F.stddev_pop(c).over(by_query())
    return F.when(sd > 1e-9, (c - F.avg(c).over(by_query())) / sd).otherwise(0.0)


def wide(*runs: DataFrame, missing: float | None = None) -> DataFrame:
    """One row per (query, document) with a score column s0, s1, ... per run."""
    n = range(len(runs))
    out = stack(*runs).groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("stream") == i, F.col("score"))).alias(f"s{i}") for i in n))
    return out if missing is None else out.fillna(missing, [f"s{i}" for i in n])


def weighted(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max normalised columns, over the weights of those present."""
    normal = scored.select("query_id", "doc_id", *(min_max(c).alias(c) for c in weights))
    up = reduce(Column.__add__, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()))
    down = reduce(Column.__add__, (F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()))
    return normal.select("query_id", "doc_id", (up / down).alias("score"))


def gate(run: DataFrame, keep: Column) -> DataFrame:
    """The documents to keep first, in their order, then the others in theirs."""
    return run.withColumn("rank", F.row_number().over(by_query().orderBy(F.when(keep, 0).otherwise(1), "rank")))


def keyword_first(keyword: DataFrame, dense: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, doc_id, tier, rank): keyword candidates (tier 0), then dense ones (1), one per title, the first.

    keyword, dense: query_id, doc_id, rank; titles: doc_id, title.
    """
    both = reduce(DataFrame.unionByName, (r.select("query_id", "doc_id", "rank", F.lit(i).alias("tier")) for i, r in enumerate((keyword, dense))))
    first = Window.partitionBy("query_id", "title").orderBy("tier", "rank")
    x = both.join(titles, "doc_id").withColumn("n", F.row_number().over(first)).where("n = 1")
    return x.select("query_id", "doc_id", "tier", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank")).alias("rank"))

"""Statistics as aggregations: correlation, rank sums, resampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than three pairs or no spread."""
    ok = (F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(ok, F.corr(x, y))


def average_rank(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """Ranks from 1, ties at their mean, within the keys."""
    by = Window.partitionBy(*keys).orderBy(column)
    return df.withColumn(name, F.rank().over(by) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2.0)


def auc(df: DataFrame, score: str, positive: Column, keys: list[str]) -> DataFrame:
    """The chance that a positive outscores a negative, by the rank sum; ties count half."""
    x = average_rank(df.withColumn("__y", positive.cast("int")), score, keys, "__r")
    p, n = F.sum("__y"), F.sum(1 - F.col("__y"))
    return x.groupBy(*keys).agg(F.round(F.when((p > 0) & (n > 0), (F.sum(F.col("__r") * F.col("__y")) - p * (p + 1) / 2) / (p * n)), 6).alias("auc"), F.count("*").alias("n"))


def bootstrap(values: DataFrame, value: str, draws: int, seed: int) -> DataFrame:
    """(draw, mean) of Poisson resamples: a row's weight in a draw follows from a hash of both.

    Rows stay where they are; each gives its weighted sums for all draws, and only these
    partial sums are shuffled.
    """
    u = F.abs(F.hash(F.lit(seed), F.col("id"), F.col("draw"))) / 2147483648.0
    weight = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    each = values.select("id", F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight)
    return each.groupBy("draw").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def interval(resamples: DataFrame) -> DataFrame:
    """Middle 95 per cent and the share of means that are not positive."""
    return resamples.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg(F.when(F.col("mean") <= 0, 1.0).otherwise(0.0)).alias("p"))


def leave_one_out(points: DataFrame) -> DataFrame:
    """One row: the line through (x, y), and the error if each point is predicted by the line through all others.

    A residual without a point is its residual over 1 - leverage, so two aggregations are
    enough and no line is fitted again. The sums are a row, so the broadcast is too.
    """
    fit = points.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), (F.var_pop("x") * F.count("*")).alias("sxx"), (F.var_pop("y") * F.count("*")).alias("syy"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    x = points.crossJoin(F.broadcast(fit))
    leverage = 1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), F.lit(2)) / F.col("sxx")
    x = x.withColumn("e", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")) / (1 - leverage))
    sums = x.groupBy("slope", "intercept", "r2", "n", "syy").agg(F.sum(F.col("e") * F.col("e")).alias("see"))
    return sums.select("slope", "intercept", "r2", F.sqrt(F.col("see") / F.col("n")).alias("loo_rmse"), (1 - F.col("see") / F.col("syy")).alias("loo_r2"))

"""Vector expressions on arrays of numbers; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for the zero vector."""
    n = norm(a)
    return F.when(n > 1e-12, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x.cast("double") / y))


def scaled(a: Column, by: Column) -> Column:
    """The vector times a number; the number is worked out once, not in the lambda."""
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, y: x.cast("double") * y)


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """weight·a + (1 - weight)·b."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.zip_with(a, b, lambda x, y: w * x.cast("double") + (1 - w) * y.cast("double"))


def sums(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Per group: `total`, the element-wise sum, and `n`.

    Elements are summed as separate rows, so a group is never gathered as a list and
    partial sums are combined before the shuffle.
    """
    parts = df.select(*keys, F.posexplode(vector).alias("__at", "__x")).groupBy(*keys, "__at").agg(F.sum(F.col("__x").cast("double")).alias("__s"), F.count("*").alias("__n"))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__s"))).alias("__l"), F.max("__n").alias("n"))
    return listed.select(*keys, F.transform("__l", lambda x: x["__s"]).alias("total"), "n")


def specificity(total: Column, n: Column) -> Column:
    """Mean cosine of unit vectors to their centroid: the length of their sum over their number."""
    return norm(total) / n


def coherence(total: Column, n: Column) -> Column:
    """Mean cosine of all pairs of unit vectors; 0 for fewer than two."""
    return F.when(n < 2, F.lit(0.0)).otherwise((dot(total, total) - n) / (n * (n - 1)))

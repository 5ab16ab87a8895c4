"""Verdicts of a corpus on hand examples."""

import math

import pytest
from pyspark.sql import functions as F

from sieveline.operators import readiness as R


def value(spark, f, *args):
    """A column function on plain numbers."""
    return spark.range(1).select(f(*(F.lit(a).cast("double") for a in args)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("schs", "perfect", "predicted", "want"),
    [(0.367, 0.008, None, "low-tax"), (0.382, 0.043, None, "low-tax"), (0.377, 0.20, 0.233, "high-rescue"), (0.30, 0.20, 0.15, "high-rescue"), (0.377, 0.20, 0.10, None), (0.35, 0.03, 0.20, "high-rescue"), (0.40, 0.01, 0.30, None), (0.299, 0.01, 0.30, None), (None, 0.01, 0.30, None)],
)
def test_false_skip_zones(spark, schs, perfect, predicted, want):
    assert value(spark, R.false_skip, schs, perfect, predicted) == want


def test_rescue(spark):
    assert value(spark, R.rescue, 9, 10, 0.5, 0.3) is None and value(spark, R.rescue, 1000, 8, 0.55, 0.85) is None
    assert value(spark, R.rescue, 1000, 8, 0.55, 0.30) == pytest.approx(max(0, min(0.4, (5.459 * math.log10(1000) - 0.014 * 8 + 52.137 * 0.55 - 46.872) / 100)))
    assert value(spark, R.rescue, 10**6, 8, 0.95, 0.30) == pytest.approx(0.353002, abs=1e-5) and value(spark, R.rescue, 20, 500, 0.2, 0.1) == 0


def test_lift_moves_the_rescue_and_not_the_lift(spark):
    lift = lambda name, *a: value(spark, lambda *c: R.lift(name, *c), *a)
    assert lift("realistic", 0.30, 0.30, 0.0, None) == pytest.approx(0.30 * 0.12 - 0.30 * 0.10)
    assert lift("optimistic", 0.5, 0.2, 0.4, 0.10) == pytest.approx(0.5 * 0.1266 - 0.2 * 0.06 * 0.6)
    assert lift("pessimistic", 0.5, 0.2, 0.4, 0.01) == pytest.approx(-0.2 * 0.15 * 0.6)
    for name in R.SCENARIOS:
        assert lift(name, 0.6, 0.05, 0.3, None) > lift(name, 0.2, 0.05, 0.3, None) and lift(name, 0.4, 0.05, 0.3, 0.1) > lift(name, 0.4, 0.3, 0.3, 0.1)


@pytest.mark.parametrize(
    ("schs", "bags", "realistic", "optimistic", "want"),
    [(0.6, 0, 0.2, 0.3, "SKIP"), (0.39, 50, 0.2, 0.3, "SKIP"), (0.40, 50, 0.02, 0.05, "GO"), (0.5, 50, 0.02, 0.049, "CONDITIONAL"), (0.5, 50, 0.01, 0.2, "SKIP"), (None, 50, 0.02, 0.06, "GO")],
)
def test_verdict(spark, schs, bags, realistic, optimistic, want):
    assert value(spark, R.verdict, schs, bags, realistic, optimistic) == want


def test_colours(spark):
    assert [value(spark, R.colour, x) for x in (0.50, 0.49, 0.40, 0.39, None)] == ["GREEN", "YELLOW", "YELLOW", "RED", "UNDETERMINED"]

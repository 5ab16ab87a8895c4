"""Whether a corpus is ready: predicted rescue, lift by scenario, verdict and its known blind spots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rescue predictor (percentage points) and its error.
RESCUE = {"log10_n": 5.459, "size": -0.014, "spec": 52.137, "constant": -46.872}
ERROR = 0.0266
# Fixed values by scenario: tax, sign of the error, and the rescue without a prediction.
SCENARIOS = {"pessimistic": (0.15, -1, 0.05), "realistic": (0.10, 0, 0.12), "optimistic": (0.06, 1, 0.25)}
#: Cohesion below which a corpus is skipped.
FLOOR = 0.40


def rescue(n: Column, size: Column, spec: Column, base: Column) -> Column:
    """Predicted share of rescued queries, 0 to 0.4; null for fewer than ten bags or a base recall of 0.85 or more."""
    points = RESCUE["log10_n"] * F.log10(n) + RESCUE["size"] * size + RESCUE["spec"] * spec + RESCUE["constant"]
    return F.when((n >= 10) & (base < 0.85), F.least(F.greatest(points / 100, F.lit(0.0)), F.lit(0.4)))


def lift(scenario: str, blind: Column, perfect: Column, base: Column, predicted: Column) -> Column:
    """Blind queries won less the tax on perfect ones. The prediction moves by its error; without one, wide bands hold."""
    tax, sign, wide = SCENARIOS[scenario]
    won = F.when(predicted.isNull(), F.lit(wide)).otherwise(F.greatest(predicted + sign * ERROR, F.lit(0.0)))
    return blind * won - perfect * tax * (1 - base)


def false_skip(schs: Column, perfect: Column, predicted: Column) -> Column:
    """Where a cohesion just below the floor is known to mislead: high-rescue before low-tax, else null."""
    near = (schs >= 0.30) & (schs < FLOOR)
    return F.when(near & (predicted >= 0.15), "high-rescue").when(near & (perfect < 0.05), "low-tax")


def verdict(schs: Column, n_bags: Column, realistic: Column, optimistic: Column) -> Column:
    """SKIP without bags or cohesion; GO needs both lifts; an unknown cohesion is not below the floor."""
    skip = (n_bags == 0) | F.coalesce(schs < FLOOR, F.lit(False))
    return F.when(skip, "SKIP").when((realistic > 0.01) & (optimistic >= 0.05), "GO").when(realistic > 0.01, "CONDITIONAL").otherwise("SKIP")


def colour(schs: Column) -> Column:
    return F.when(schs.isNull(), "UNDETERMINED").when(schs >= 0.5, "GREEN").when(schs >= FLOOR, "YELLOW").otherwise("RED")

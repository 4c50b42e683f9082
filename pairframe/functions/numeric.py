"""Scalar numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: spacing of float64 at 1.0, as used by the constant-feature rule.
FLOAT64_EPS = 2.220446049250313e-16


def nan_to_null(value: Column) -> Column:
    """NaN means missing: aggregates skip null but would propagate NaN."""
    return F.when(~F.isnan(value), value)


def safe_scale(mean: Column, variance: Column, rows: Column) -> Column:
    """Standard deviation, or 1 where the variance is only rounding noise.

    A group counts as constant when its variance is within the error bound of a
    float64 variance over `rows` values around `mean`.
    """
    noise = rows * F.lit(FLOAT64_EPS) * variance + F.pow(rows * mean * F.lit(FLOAT64_EPS), F.lit(2.0))
    return F.when(variance <= noise, F.lit(1.0)).otherwise(F.sqrt(variance))

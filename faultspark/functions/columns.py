"""Small column helpers. NaN is data here, and Spark orders it above every number: compare only after finite()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """True for numbers; false for null, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != INF), F.lit(False))


def or_nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def wrap_longitude(c: Column) -> Column:
    """Longitudes above 180 minus 360."""
    return F.when(c <= 180, c).otherwise(c - 360)


def clamp01(c: Column) -> Column:
    """Into [0, 1]; NaN and null stay."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def nan_to_zero(c: Column) -> Column:
    return F.nanvl(c, F.lit(0.0))

"""Arithmetic on nullable numbers: partial-credit scores, ratios, displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return 100.0 * ratio(a, b)


def band_points(value: Column, low: float, high: float, weight: float) -> Column:
    """All points within [low, high]; outside the share of the nearer edge, never below 0; null: 0."""
    edge = F.when(value < low, F.lit(low)).otherwise(F.lit(high))
    part = ratio(F.least(value, edge), F.greatest(value, edge))
    points = F.when(value.between(low, high), F.lit(float(weight))).otherwise(
        weight * F.greatest(F.lit(0.0), F.coalesce(part, F.lit(0.0)))
    )
    return F.round(F.when(value.isNull(), 0.0).otherwise(points), 2)


def floor_points(value: Column, floor: float, weight: float) -> Column:
    """All points from the floor on; below it in proportion; null: 0. More than the floor earns no more."""
    points = F.when(value >= floor, F.lit(float(weight))).otherwise(weight * F.greatest(F.lit(0.0), value / floor))
    return F.round(F.when(value.isNull(), 0.0).otherwise(points), 2)


def cap_points(top1: Column, top5: Column, cap1: float, cap5: float, weight: float) -> Column:
    """The mean of two halves, each in full up to its cap and cap / value beyond; a null half earns 0."""

    def half(value: Column, cap: float) -> Column:
        return F.when(value.isNull(), 0.0).when(value <= cap, 1.0).otherwise(cap / value)

    return F.round(weight * (half(top1, cap1) + half(top5, cap5)) / 2, 2)


def plain_number(value: Column) -> Column:
    """A whole number without a fraction, else up to four decimals without trailing zeros."""
    whole = F.round(value, 0).cast("decimal(38,0)").cast("string")
    parts = F.round(value, 4).cast("decimal(38,4)").cast("string")
    return F.when(value == F.floor(value), whole).otherwise(F.regexp_replace(parts, r"\.?0+$", ""))


def money_display(value: Column) -> Column:
    """``$8.4M`` from a million on, else ``$358,333``; a null is ``not stated``."""
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    millions = F.concat(sign, F.lit("$"), F.round(size / 1e6, 1).cast("decimal(20,1)").cast("string"), F.lit("M"))
    units = F.concat(sign, F.lit("$"), F.format_number(F.round(size, 0), 0))
    return F.when(value.isNull(), "not stated").when(size >= 1e6, millions).otherwise(units)

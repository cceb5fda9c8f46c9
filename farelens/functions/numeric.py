"""Rounding, clamping and division helpers.

Spark 4 runs in ANSI mode: dividing by zero raises. The helpers here return null (or zero, where
that is the rule) instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits kept below the wanted ones before a mean is rounded; removes the noise of summation order.
_GUARD_DIGITS = 6


def rounded(col: Column, digits: int = 2) -> Column:
    """Half-even rounding of a row value: ``rint(x * 10^d) / 10^d``."""
    scale = 10.0**digits
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def rounded_mean(col: Column, digits: int = 2) -> Column:
    """Half-even rounding of an aggregate.

    Partial sums merge in a different order on every run, so a mean that lies on a rounding boundary
    could fall to either side. Snapping to six further digits first makes the result repeatable.
    """
    guard = 10.0**_GUARD_DIGITS
    scale = 10.0**digits
    return F.rint(F.rint(col * F.lit(scale * guard)) / F.lit(guard)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero."""
    return F.try_divide(numerator, denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient, zero when the denominator is not positive."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(F.lit(0.0))


def clamp(col: Column, low: float | Column, high: float | Column) -> Column:
    """Value moved into [low, high]; null stays null."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    # greatest/least skip nulls and would turn a null into a bound.
    return F.when(col.isNotNull(), F.greatest(low, F.least(high, col)))


def between_bounds(col: Column, low: Column, high: Column) -> Column:
    """Value replaced by a bound when it lies strictly outside; null bounds change nothing."""
    return F.when(col < low, low).when(col > high, high).otherwise(col)


def clamp_load(col: Column) -> Column:
    """Competitor and historical load factors stay within [0.3, 0.95]."""
    return clamp(col, 0.3, 0.95)


def null_if_nan(col: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(col), col)

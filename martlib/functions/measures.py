"""Guarded ratios and forecast error measures.

ANSI mode raises on division by zero; every ratio here returns null instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """numerator / denominator, rounded half-up."""
    return F.round(F.try_divide(numerator, denominator), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part as a percentage of whole."""
    share = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return F.round(share, digits)


def percent_change(new: Column, old: Column, digits: int = 2) -> Column:
    """Growth from old to new in percent; the difference is taken on exact decimals."""
    return percent(new - old, old, digits)


def wape(actual: Column, predicted: Column) -> Column:
    """Weighted absolute percentage error, an aggregate expression."""
    return 100.0 * F.try_divide(F.sum(F.abs(actual - predicted)), F.sum(F.abs(actual)))


def r_squared(actual: Column, predicted: Column, mean: Column) -> Column:
    """1 - SSres/SStot, an aggregate expression over rows that carry their group's mean."""
    residual = F.sum((actual - predicted) * (actual - predicted))
    total = F.sum((actual - mean) * (actual - mean))
    return 1.0 - F.try_divide(residual, total)

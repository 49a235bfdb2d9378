"""Ratios and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double, 0 where d is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def pct(n: Column, d: Column, digits: int = 2) -> Column:
    """n in percent of d, rounded; 0 where d is 0."""
    return F.round(ratio(n, d) * 100, digits)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall, 0 where both are 0."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def log_product(a: Column, b: Column) -> Column:
    """Decimal logarithm of a * b; null where the product is not positive."""
    return F.when(a * b > 0, F.log10(a * b))

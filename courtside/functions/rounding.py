"""Rounding that agrees on every engine: half-even on the scaled double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 6) -> Column:
    """rint(x * 10^digits) / 10^digits, never -0.0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits)) + F.lit(0.0)


def whole(x: Column | str) -> Column:
    """The nearest integer, ties to even."""
    return F.rint(x).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))

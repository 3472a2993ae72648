"""Rounding, means and shares.

One rule everywhere: go through ``decimal(18,6)`` before rounding, so that a value such
as 12.345 rounds half away from zero whatever its binary representation is, and return
a double.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL when ``whole`` is zero."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return fixed(ratio(part * F.lit(100.0), whole), digits)


def mean(total: Column, filled: Column, digits: int = 2) -> Column:
    """A mean from its sum and its count of non-NULL values."""
    return fixed(ratio(total, filled), digits)

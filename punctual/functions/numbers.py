"""Rounding that stays exact.

Shares and means are quotients of integers, so they are rounded half away from
zero in integer arithmetic: no binary fraction can tip a tie, and the result
does not depend on the precision Spark picks for a decimal division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``numerator / denominator`` of integers, rounded; NULL when dividing by zero."""
    n, d = numerator.cast("bigint"), F.nullif(denominator.cast("bigint"), F.lit(0))
    scaled = F.call_function("div", F.abs(n) * F.lit(2 * 10**digits) + d, d * 2)
    return F.signum(n) * scaled / F.lit(float(10**digits))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of ``part`` in ``whole``."""
    return ratio(part * F.lit(100), whole, digits)


def mean(column: Column, digits: int = 2) -> Column:
    """Rounded mean of an integer column; NULLs are skipped."""
    return ratio(F.sum(column.cast("bigint")), F.count(column), digits)


def rounded(value: Column, digits: int) -> Column:
    """Round a fractional value half away from zero, through a decimal."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")

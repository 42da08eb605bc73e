"""Dates and durations over zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 86_400 * SECOND


def month_of(moment: Column) -> Column:
    """First day of the month."""
    return F.trunc(F.to_date(moment), "MM")


def micros(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``.

    ``timestamp_diff`` would read the moments in the session's time zone and so count a
    change of clocks; their plain difference does not. Seconds with six decimals survive
    a double exactly for almost three centuries.
    """
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return F.rint(seconds.cast("double") * SECOND).cast("bigint")


def elapsed(start: Column, end: Column, unit: int = DAY) -> Column:
    """Fractional length in ``unit`` microseconds; negative when ``end`` is earlier."""
    return micros(start, end) / F.lit(float(unit))


def stage(start: Column, end: Column, unit: int = DAY) -> Column:
    """As ``elapsed``, but NULL when the two moments are out of order."""
    return F.when(end >= start, elapsed(start, end, unit))


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour days between two moments (not calendar days)."""
    return F.extract(F.lit("DAY"), end - start)

"""The tables of one dataset, opened on demand."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame

from punctual.fixed_values import (
    BASELINE_MONTH,
    EXPECTED_ROWS,
    STAGE_PERIOD,
    TAIL_START,
    WORKING_PERIOD,
    Period,
)


@dataclass(frozen=True)
class Calendar:
    """Dates the queries are run for."""

    period: Period = WORKING_PERIOD
    stages: Period = STAGE_PERIOD
    tail: date = TAIL_START
    baseline: date = BASELINE_MONTH


@dataclass(frozen=True)
class Model:
    """Tables by name.

    ``opener(name)`` returns a whole table. ``orders_opener(start, end)``, where given,
    returns at least the orders bought in ``[start, end)`` (either may be None) and lets
    a source skip files that cannot hold any; the caller still filters on the purchase.
    ``placed``, where given, opens the orders with their customers' places, which need no join.
    ``prepared``, where given, opens the sample that ``plans.prepared`` wrote.
    """

    opener: Callable[[str], DataFrame]
    orders_opener: Callable[[date | None, date | None], DataFrame] | None = None
    tables: tuple[str, ...] = tuple(EXPECTED_ROWS)
    expected: Mapping[str, int] = field(default_factory=lambda: EXPECTED_ROWS)
    calendar: Calendar = Calendar()
    prepared: Callable[[], DataFrame] | None = None
    placed: Callable[[], DataFrame] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.opener(name)

    def orders_near(self, start: date | None = None, end: date | None = None) -> DataFrame:
        if self.orders_opener is None:
            return self.opener("orders")
        return self.orders_opener(start, end)

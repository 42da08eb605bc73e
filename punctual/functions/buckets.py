"""Ordered buckets of whole days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.fixed_values import DAY_EDGES


@dataclass(frozen=True)
class Buckets:
    """Inclusive upper edges, then one open bucket.

    ``first`` is the label's lower end of the first bucket. With ``closed`` a value
    below it belongs to no bucket; otherwise the first bucket is open downwards.
    NULL, and any value without a bucket, goes to the last one.
    """

    edges: tuple[int, ...] = DAY_EDGES
    first: int = 0
    closed: bool = False
    suffix: str = ""

    def _lows(self) -> list[int]:
        return [self.first, *(edge + 1 for edge in self.edges)]

    def labels(self) -> list[str]:
        lows = self._lows()
        spans = [f"{low}-{high}" for low, high in zip(lows, self.edges)]
        return [text + self.suffix for text in (*spans, f"{lows[-1]}+")]

    def number(self, value: Column) -> Column:
        """1-based position of the bucket; the only part that needs to be shuffled."""
        lows = self._lows()
        tests = [value.between(low, high) for low, high in zip(lows, self.edges)]
        if not self.closed:
            tests[0] = value <= self.edges[0]
        picked = F.when(tests[0], 1)
        for position, test in enumerate(tests[1:], start=2):
            picked = picked.when(test, position)
        return picked.otherwise(len(self.edges) + 1)

    def label(self, number: Column) -> Column:
        """Label of a bucket position."""
        return F.element_at(F.array(*map(F.lit, self.labels())), number)

    def width(self, number: Column, longest: Column) -> Column:
        """Days a bucket spans; the open one ends at ``longest``."""
        lows = self._lows()
        closed = [high - low + 1 for low, high in zip(lows, self.edges)]
        spans = F.array(*map(F.lit, closed), (longest - self.edges[-1]).cast("int"))
        return F.element_at(spans, number)


DELIVERY_BUCKETS = Buckets()
LATENESS_BUCKETS = Buckets(first=1, closed=True)

"""Values that decide results, gathered in one place.

Everything here is a default: each operator takes the same value as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# --- Fixed values: order states the analysis looks at -----------------------
DELIVERED = "delivered"
SHIPPED = "shipped"

# --- Fixed values: buckets of whole days ------------------------------------
# Upper edges, inclusive; one open bucket follows the last edge.
DAY_EDGES = (3, 7, 14, 23, 30, 60)
# Label suffix of the order sheet ("days", abbreviated, in Russian).
SHEET_SUFFIX = " дн."

# --- Fixed values: labels of a review id that occurs more than once ---------
SEVERAL_ORDERS = "разные заказы"
SAME_ORDER = "тот же заказ"

# --- Fixed values: row counts of the full public dataset --------------------
EXPECTED_ROWS = {
    "customers": 99441,
    "sellers": 3095,
    "products": 32951,
    "orders": 99441,
    "order_items": 112650,
    "order_payments": 103886,
    "order_reviews": 99224,
    "category_translation": 71,
}


@dataclass(frozen=True)
class Period:
    """Half-open range of purchase dates: ``start <= purchase < end``."""

    start: date
    end: date

    def months(self) -> int:
        """Calendar months the range can touch (a size bound for monthly results)."""
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1


# --- Fixed values: periods of the full public dataset -----------------------
WORKING_PERIOD = Period(date(2017, 1, 1), date(2018, 9, 1))
STAGE_PERIOD = Period(date(2017, 12, 1), date(2018, 5, 1))
TAIL_START = date(2018, 9, 1)
BASELINE_MONTH = date(2017, 10, 1)

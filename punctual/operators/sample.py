"""The working sample: delivered orders of the period with their SLA measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.fixed_values import DELIVERED, Period
from punctual.functions import elapsed, month_of, stage
from punctual.functions.times import HOUR

PURCHASE = "order_purchase_timestamp"
APPROVED = "order_approved_at"
CARRIER = "order_delivered_carrier_date"
RECEIVED = "order_delivered_customer_date"
ESTIMATE = "order_estimated_delivery_date"
# Orders that carry their customer's state and city say here whether there is such a customer.
CUSTOMER_FOUND = "customer_found"


def bought_in(start, end) -> Column:
    """Half-open filter on the purchase moment, as stored, so that it reaches the scan."""
    purchase = F.col(PURCHASE)
    return (purchase >= F.lit(start).cast("timestamp_ntz")) & (purchase < F.lit(end).cast("timestamp_ntz"))


def with_measures(orders: DataFrame) -> DataFrame:
    """Add the SLA measures of each order; a measure lacking a date is NULL.

    Lateness compares dates, since the estimate is always a midnight. A handover or
    transit out of order is NULL in that stage only; the order stays.
    """
    purchase, approved, carrier, received, estimate = map(F.col, (PURCHASE, APPROVED, CARRIER, RECEIVED, ESTIMATE))
    against_estimate = F.datediff(received, estimate)
    return orders.withColumns({
        "purchase_month": month_of(purchase),
        "is_late": against_estimate > 0,
        "days_vs_estimate": against_estimate,
        "delivery_days": F.datediff(received, purchase),
        "promise_days": F.datediff(estimate, purchase),
        "cycle_days": elapsed(purchase, received),
        "approve_hours": elapsed(purchase, approved, HOUR),
        "handover_days": stage(approved, carrier),
        "transit_days": stage(carrier, received),
    })


def delivered_orders(orders: DataFrame, customers: DataFrame, period: Period, status: str = DELIVERED) -> DataFrame:
    """One row per delivered order of the period, with the customer's state and city.

    The customer is matched by key, as an order without one is left out. Columns that a
    query does not use are pruned through the join, so it only carries what is needed.
    Orders that were stored with their customer's places (``customer_found``) need no join.
    """
    kept = orders.filter(
        (F.col("order_status") == status) & F.col(RECEIVED).isNotNull() & bought_in(period.start, period.end)
    )
    if CUSTOMER_FOUND in orders.columns:
        placed = kept.filter(CUSTOMER_FOUND)
    else:
        placed = kept.join(customers.select("customer_id", "customer_state", "customer_city"), "customer_id")
    return with_measures(placed).select(
        "order_id",
        "customer_state",
        "customer_city",
        PURCHASE,
        APPROVED,
        CARRIER,
        RECEIVED,
        ESTIMATE,
        "purchase_month",
        "is_late",
        "days_vs_estimate",
        "delivery_days",
        "promise_days",
        "cycle_days",
        "approve_hours",
        "handover_days",
        "transit_days",
    )


VIEW_COLUMNS = (
    "order_id", "customer_state", "customer_city", PURCHASE, APPROVED, CARRIER, RECEIVED, ESTIMATE,
    "purchase_month", "is_late", "days_vs_estimate", "delivery_days", "cycle_days", "approve_hours",
    "handover_days", "transit_days",
)


def create_view(sample: DataFrame, name: str = "delivered_orders") -> None:
    """Register the sample for SQL, replacing an earlier view of that name."""
    sample.select(*VIEW_COLUMNS).createOrReplaceTempView(name)

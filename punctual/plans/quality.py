"""Data-quality queries over the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.fixed_values import DELIVERED, SHIPPED
from punctual.functions import mean, month_of, rounded, share, whole_days
from punctual.operators import profile
from punctual.operators.percentiles import percentile
from punctual.operators.profile import Order
from punctual.operators.sample import APPROVED, CARRIER, PURCHASE, RECEIVED, bought_in
from punctual.sources.model import Model


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == DELIVERED)


def _shipped(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == SHIPPED)


def _broken_stages() -> list[Column]:
    return [
        F.count_if(F.col(CARRIER) < F.col(APPROVED)).alias("handover_bad"),
        F.count_if(F.col(RECEIVED) < F.col(CARRIER)).alias("transit_bad"),
    ]


def row_counts(model: Model) -> DataFrame:
    """Rows of each table beside the number expected after a full load."""
    return profile.row_counts({table: model[table] for table in model.tables}, model.expected)


def purchase_span(model: Model) -> DataFrame:
    """First and last purchase date."""
    return profile.date_span(model["orders"], PURCHASE, "first_order", "last_order")


def status_shares(model: Model) -> DataFrame:
    """Orders per status and their share."""
    shares = profile.value_shares(model["orders"], "order_status", "orders", "share_pct")
    return shares.orderBy(F.desc("orders"), F.asc_nulls_last("order_status"))


def missing_dates(model: Model) -> DataFrame:
    """Dates missing per status: a status fills the dates up to its own step."""
    columns = {"no_approved": APPROVED, "no_carrier": CARRIER, "no_delivered": RECEIVED}
    missing = profile.null_profile(model["orders"], "order_status", columns)
    return missing.orderBy(F.desc("orders_count"), F.asc_nulls_last("order_status"))


def delivered_without_date(model: Model) -> DataFrame:
    """Delivered orders that lack a delivery date."""
    return (
        _delivered(model["orders"])
        .filter(F.col(RECEIVED).isNull())
        .select("order_id", "order_status", PURCHASE, APPROVED, CARRIER, RECEIVED)
        .orderBy("order_id")
    )


def date_order(model: Model) -> DataFrame:
    """Steps recorded before the step they follow, over all orders."""
    rules = [
        Order("approved_to_purchase", PURCHASE, APPROVED, "approved_count"),
        Order("carrier_to_approved", APPROVED, CARRIER, "carrier_count"),
        Order("customer_to_carrier", CARRIER, RECEIVED, "customer_count"),
    ]
    # The last rule's base counts every handover, whether or not the purchase is known.
    from_purchase = Order("carrier_to_purchase", PURCHASE, CARRIER, "carrier_base")
    return profile.chronology(model["orders"], [*rules, from_purchase], untested={"carrier_base": (PURCHASE,)})


def date_order_by_status(model: Model) -> DataFrame:
    """The two stage violations per status."""
    return (
        model["orders"]
        .groupBy("order_status")
        .agg(F.count("*").alias("orders"), *_broken_stages())
        .orderBy(F.desc("handover_bad"), F.asc_nulls_last("order_status"))
    )


def date_order_before_period(model: Model) -> DataFrame:
    """The same among dated deliveries bought before the period."""
    start = model.calendar.period.start
    early = _delivered(model.orders_near(end=start)).filter(
        F.col(RECEIVED).isNotNull() & (F.col(PURCHASE) < F.lit(start).cast("timestamp_ntz"))
    )
    return early.agg(*_broken_stages())


def review_repeats(model: Model) -> DataFrame:
    """Both profiles as one row; each is a row already, so they are stacked and folded."""
    reviews = model["order_reviews"]
    by_id = profile.multiplicity(reviews, "review_id").withColumn("key", F.lit("id"))
    by_order = profile.multiplicity(reviews, "order_id").withColumn("key", F.lit("order"))

    def of(key: str, column: str, name: str):
        return F.max(F.when(F.col("key") == key, F.col(column))).alias(name)

    return by_id.unionByName(by_order).agg(
        of("id", "total", "total_rows"),
        of("id", "repeated", "review_ids_with_duplicates"),
        of("id", "once", "review_ids_with_no_duplicates"),
        of("order", "once", "orders_with_one_review"),
        of("order", "repeated", "orders_with_several_reviews"),
    )


def repeat_pattern(model: Model) -> DataFrame:
    """Whether a repeated review id spans several orders."""
    return profile.repeat_pattern(model["order_reviews"], "review_id", "order_id")


def orders_by_month(model: Model) -> DataFrame:
    """Orders per purchase month, whatever their status."""
    return (
        model["orders"]
        .groupBy(month_of(F.col(PURCHASE)).alias("month"))
        .agg(F.count("*").alias("orders_count"))
        .orderBy(F.asc_nulls_last("month"))
    )


def tail_orders(model: Model) -> DataFrame:
    """Orders bought after the period, whole."""
    tail = model.calendar.tail
    return (
        model.orders_near(start=tail)
        .filter(F.col(PURCHASE) >= F.lit(tail).cast("timestamp_ntz"))
        .orderBy(PURCHASE, "order_id")
    )


def shipped_total(model: Model) -> DataFrame:
    """Orders that never got past shipping."""
    return _shipped(model["orders"]).agg(F.count("*").alias("shipped_orders"))


def shipped_in_period(model: Model) -> DataFrame:
    """The same, bought in the period."""
    period = model.calendar.period
    orders = model.orders_near(period.start, period.end).filter(bought_in(period.start, period.end))
    return _shipped(orders).agg(F.count("*").alias("shipped_orders"))


def stuck_age(model: Model) -> DataFrame:
    """Whole days from purchase to the last purchase of the data, over shipped orders."""
    last = model["orders"].agg(F.max(PURCHASE)).scalar()
    aged = _shipped(model["orders"]).select(whole_days(F.col(PURCHASE), last).alias("age"))
    age = F.col("age")
    return aged.agg(
        F.min(age).alias("min_days_passed"),
        rounded(percentile(age, 0.5)[0], 0).alias("median_days_passed"),
        mean(age, 0).alias("avg_days_passed"),
        F.max(age).alias("max_days_passed"),
    )


def stuck_by_year(model: Model) -> DataFrame:
    """Orders stuck in shipping per purchase year."""
    return (
        _shipped(model["orders"])
        .groupBy(F.year(PURCHASE).alias("year"))
        .agg(F.count("*").alias("shipped_orders"))
        .orderBy(F.asc_nulls_last("year"))
    )


def sample_arithmetic(model: Model) -> DataFrame:
    """Parts of the sample size in one pass; the last purchase also looks at undated orders."""
    dated = F.col(RECEIVED).isNotNull()
    early = F.col(PURCHASE) < F.lit(model.calendar.period.start).cast("timestamp_ntz")
    return _delivered(model["orders"]).agg(
        F.count_if(dated).alias("delivered_ok"),
        F.count_if(dated & early).alias("before_period"),
        F.max(PURCHASE).alias("last_purchase"),
    )


def anomalous_delivered(model: Model) -> DataFrame:
    """Delivered orders lacking any date, each counted once."""
    missing = [F.col(c).isNull() for c in (APPROVED, CARRIER, RECEIVED)]
    return _delivered(model["orders"]).agg(
        F.count_if(missing[0]).alias("no_approved"),
        F.count_if(missing[1]).alias("no_carrier"),
        F.count_if(missing[2]).alias("no_delivered"),
        F.count_if(missing[0] | missing[1] | missing[2]).alias("anomalous_orders"),
    )


def period_share(model: Model) -> DataFrame:
    """Orders inside and outside the working period."""
    period = model.calendar.period
    inside = F.count_if(bought_in(period.start, period.end))
    return model["orders"].agg(
        inside.alias("in_period"),
        share(inside, F.count("*")).alias("in_period_pct"),
        (F.count("*") - inside).alias("excluded"),
        share(F.count("*") - inside, F.count("*")).alias("excluded_pct"),
    )


def estimate_completeness(model: Model) -> DataFrame:
    """Orders that have an estimated date."""
    estimate = F.col("order_estimated_delivery_date")
    return model["orders"].agg(F.count("*").alias("orders_count"), F.count(estimate).alias("with_estimate"))


def median_month_volume(model: Model) -> DataFrame:
    """Median orders per month over the working period, all statuses."""
    period = model.calendar.period
    months = (
        model.orders_near(period.start, period.end)
        .filter(bought_in(period.start, period.end))
        .groupBy(month_of(F.col(PURCHASE)).alias("month"))
        .agg(F.count("*").alias("n"))
    )
    return months.agg(
        F.count("*").alias("months"), rounded(percentile(F.col("n"), 0.5)[0], 1).alias("median_orders")
    )


def tail_statuses(model: Model) -> DataFrame:
    """Status mix of the orders after the period."""
    tail = model.calendar.tail
    return (
        model.orders_near(start=tail)
        .filter(F.col(PURCHASE) >= F.lit(tail).cast("timestamp_ntz"))
        .groupBy("order_status")
        .agg(F.count("*").alias("orders_count"))
        .orderBy(F.desc("orders_count"), F.asc_nulls_last("order_status"))
    )


def review_order_pairs(model: Model) -> DataFrame:
    """Whether (review, order) identifies a review row: pairs, and pairs that repeat."""
    pairs = profile.multiplicity(model["order_reviews"], "review_id", "order_id")
    return pairs.select("total", F.col("once").alias("pairs_once"), F.col("repeated").alias("pairs_repeated"))


def distinct_per_review(model: Model) -> DataFrame:
    """Rows, distinct orders, scores and dates of each review id."""
    return profile.distinct_counts(
        model["order_reviews"], ["review_id"],
        {"orders": "order_id", "scores": "review_score", "dates": "review_creation_date"}, "reviews",
    )


def distinct_per_status(model: Model) -> DataFrame:
    """Orders, distinct customers and distinct purchase days of each status: few groups, most rows in one."""
    orders = model["orders"].withColumn("purchase_day", F.to_date("order_purchase_timestamp"))
    return profile.distinct_counts(
        orders, ["order_status"], {"customers": "customer_id", "purchase_days": "purchase_day"}, "orders_count"
    )

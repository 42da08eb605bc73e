"""SLA queries over the working sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.fixed_values import Period
from punctual.functions import ratio, rounded, share
from punctual.functions.buckets import DELIVERY_BUCKETS, LATENESS_BUCKETS
from punctual.functions.times import micros
from punctual.operators import metrics
from punctual.operators.histogram import all_rows, histogram, histogram_of_part
from punctual.operators.percentiles import percentile
from punctual.operators.sample import CARRIER, PURCHASE, RECEIVED, VIEW_COLUMNS, delivered_orders
from punctual.sources.model import Model


def sample(model: Model, within: Period | None = None) -> DataFrame:
    """The working sample, as prepared or else from the orders.

    ``within`` lets the source skip orders that the query drops anyway.
    """
    if model.prepared is not None:
        return model.prepared()
    period = model.calendar.period
    near = within or period
    orders = model.placed() if model.placed is not None else model.orders_near(
        max(period.start, near.start), min(period.end, near.end)
    )
    return delivered_orders(orders, model["customers"], period)


def view(model: Model) -> DataFrame:
    """The sample with the columns of the SQL view."""
    return sample(model).select(*VIEW_COLUMNS)


def view_check(model: Model) -> DataFrame:
    """Control counts of the sample."""
    return metrics.sample_check(sample(model))


def overview(model: Model) -> DataFrame:
    """Size, lateness and delivery time of the whole sample."""
    return metrics.overview(sample(model))


def delivery_histogram(model: Model) -> DataFrame:
    """Orders per delivery-time bucket."""
    buckets = histogram(sample(model), "delivery_days", DELIVERY_BUCKETS).orderBy("bucket_no")
    return buckets.select("bucket", "orders", "pct", "cum_pct")


def lateness_histogram(model: Model) -> DataFrame:
    """Late orders per bucket of days late."""
    buckets = histogram_of_part(sample(model), "days_vs_estimate", LATENESS_BUCKETS, "is_late")
    return buckets.orderBy("bucket_no").drop("bucket_no")


def buffer(model: Model) -> DataFrame:
    """Days to spare of the orders that were on time."""
    return metrics.buffer(sample(model))


def by_month(model: Model) -> DataFrame:
    """SLA measures per purchase month, with the cushion of the promise."""
    summary = metrics.sla_summary(sample(model), "purchase_month", promise_digits=None, cushion=True)
    return summary.orderBy(F.asc_nulls_last("purchase_month"))


def promise_cut(model: Model) -> DataFrame:
    """What cutting the promise by one to seven days would cost."""
    return metrics.promise_cut(sample(model))


def stages(model: Model) -> DataFrame:
    """90th percentile of each stage per month."""
    months = model.calendar.stages
    return metrics.stage_breakdown(sample(model, months), months).orderBy(F.asc_nulls_last("purchase_month"))


def stage_spread(model: Model) -> DataFrame:
    """10th, 50th and 90th percentile of each stage per month and state."""
    return metrics.stage_spread(sample(model), "purchase_month", "customer_state")


# --- Figures the analysis quotes without a query of their own ----------------


def days_late(model: Model) -> DataFrame:
    """How late the late orders are."""
    late = percentile(F.col("days_vs_estimate"), 0.5, 0.9)
    return sample(model).filter("is_late").agg(
        rounded(late[0], 2).alias("median_days_late"),
        rounded(late[1], 2).alias("p90_days_late"),
        F.max("days_vs_estimate").alias("max_days_late"),
    )


def promise_days(model: Model) -> DataFrame:
    """Length of the promise."""
    promise = percentile(F.col("promise_days"), 0.5, 0.9)
    return sample(model).agg(
        rounded(promise[0], 2).alias("median_promise_days"), rounded(promise[1], 2).alias("p90_promise_days")
    )


def cut_check(model: Model, cut: int = 7) -> DataFrame:
    """Orders a cut would tip, counted directly and read off the curve."""
    curve = metrics.promise_cut(sample(model), None).filter(F.col("cut_days") <= cut)
    tipped = F.count_if((F.col("is_late") == F.lit(False)) & (-F.col("days_vs_estimate") < cut))
    return sample(model).agg(
        tipped.alias("counted"),
        F.max(curve.agg(F.coalesce(F.max("will_be_late"), F.lit(0))).scalar()).alias("on_curve"),
    ).withColumn("agree", F.col("counted") == F.col("on_curve"))


def mean_and_median(model: Model) -> DataFrame:
    """Skew of the delivery time: mean over median, and orders faster than the mean."""
    days, n = F.col("delivery_days"), F.col("n")
    counts = (
        sample(model)
        .filter(days.isNotNull())
        .groupBy(days)
        .agg(F.count("*").alias("n"))
        .withColumn("orders", F.sum(n).over(all_rows()))
        .withColumn("all_days", F.sum(days * n).over(all_rows()))
    )
    faster = F.sum(F.when(days * F.col("orders") < F.col("all_days"), n).otherwise(0))
    median = F.percentile(days, F.lit(0.5), n)
    return counts.agg(
        rounded(F.max("all_days") / F.max("orders") / F.nullif(median, F.lit(0.0)), 2).alias("mean_to_median"),
        share(faster, F.max("orders")).alias("faster_than_mean_pct"),
    )


def _counted_buckets(model: Model) -> DataFrame:
    """Delivery buckets with their count, the total, and the longest delivery of all."""
    number = DELIVERY_BUCKETS.number(F.col("delivery_days")).alias("bucket_no")
    return (
        sample(model)
        .groupBy(number)
        .agg(F.count("*").alias("orders"), F.max("delivery_days").alias("longest"))
        .withColumn("total", F.sum("orders").over(all_rows()))
        .withColumn("longest", F.max("longest").over(all_rows()))
        .withColumn("bucket", DELIVERY_BUCKETS.label(F.col("bucket_no")))
    )


def bucket_density(model: Model) -> DataFrame:
    """Share of orders per day of a bucket's width."""
    width = DELIVERY_BUCKETS.width(F.col("bucket_no"), F.col("longest"))
    return (
        _counted_buckets(model)
        .withColumn("days", width)
        .orderBy("bucket_no")
        .select("bucket", "days", share(F.col("orders"), F.col("total") * F.col("days"), 3).alias("pct_per_day"))
    )


def days_per_point(model: Model) -> DataFrame:
    """Days of promise that one more percentage point on time costs, bucket by bucket."""
    edge = F.element_at(
        F.array(*map(F.lit, DELIVERY_BUCKETS.edges), F.col("longest").cast("int")), F.col("bucket_no")
    )
    return (
        _counted_buckets(model)
        .withColumn("up_to_days", edge)
        .withColumn("more_days", F.col("up_to_days") - F.lag("up_to_days").over(Window.orderBy("bucket_no")))
        .orderBy("bucket_no")
        .select(
            "bucket",
            "up_to_days",
            "more_days",
            ratio(F.col("more_days") * F.col("total"), F.col("orders") * 100).alias("days_per_point"),
        )
    )


def marginal_cut(model: Model, rows: int = 7) -> DataFrame:
    """Points of late share that each further day cut adds to the one before."""
    in_order = Window.orderBy("cut_days")
    before = F.lag("will_be_late_pct").over(in_order)
    curve = metrics.cut_curve(sample(model))
    return (
        curve.withColumn(
            "added_points", rounded(F.col("will_be_late_pct") - F.coalesce(before, F.col("late_pct")), 2)
        )
        .select("cut_days", "will_be_late_pct", "added_points")
        .orderBy("cut_days")
        .limit(rows)
    )


def slowest_by_month(model: Model, point: float = 0.97) -> DataFrame:
    """Delivery time that nearly all orders of a month kept."""
    return (
        sample(model)
        .groupBy("purchase_month")
        .agg(rounded(percentile(F.col("delivery_days"), point)[0], 2).alias("p97_delivery_days"))
        .orderBy(F.asc_nulls_last("purchase_month"))
    )


def _monthly(model: Model) -> DataFrame:
    return sample(model).groupBy("purchase_month").agg(
        F.count("*").alias("orders_count"), metrics.late().alias("late_orders_count")
    )


def excess_late(model: Model) -> DataFrame:
    """Late orders beyond what the baseline month's rate would give."""

    def baseline(column: str):
        value = F.when(F.col("purchase_month") == F.lit(model.calendar.baseline), F.col(column))
        return F.max(value).over(all_rows()).cast("decimal(18,0)")

    expected = F.col("orders_count").cast("decimal(18,0)") * baseline("late_orders_count") / F.nullif(
        baseline("orders_count"), F.lit(0).cast("decimal(18,0)")
    )
    return (
        _monthly(model)
        .withColumn("excess_late", F.round(F.col("late_orders_count") - expected, 0).cast("bigint"))
        .orderBy(F.asc_nulls_last("purchase_month"))
    )


def volume_ratio(model: Model) -> DataFrame:
    """Orders of a month against the month before, beside its late share."""
    previous = F.lag("orders_count").over(Window.orderBy(F.asc_nulls_last("purchase_month")))
    return (
        _monthly(model)
        .select(
            "purchase_month",
            "orders_count",
            ratio(F.col("orders_count"), previous).alias("to_previous"),
            share(F.col("late_orders_count"), F.col("orders_count")).alias("late_orders_pct"),
        )
        .orderBy(F.asc_nulls_last("purchase_month"))
    )


def late_spread(model: Model) -> DataFrame:
    """Best and worst monthly late share, and how many times apart they are."""
    pct = share(F.col("late_orders_count"), F.col("orders_count"))
    return _monthly(model).agg(F.min(pct).alias("least_pct"), F.max(pct).alias("most_pct")).withColumn(
        "times_apart", rounded(F.col("most_pct") / F.nullif(F.col("least_pct"), F.lit(0.0)), 1)
    )


def state_concentration(model: Model) -> DataFrame:
    """States by size, with the cumulative share of orders."""
    largest_first = [F.desc("orders_count"), F.asc_nulls_last("customer_state")]
    return (
        sample(model)
        .groupBy("customer_state")
        .agg(F.count("*").alias("orders_count"))
        .withColumn("upto", F.sum("orders_count").over(Window.orderBy(*largest_first)))
        .withColumn("total", F.sum("orders_count").over(all_rows()))
        .orderBy(*largest_first)
        .select("customer_state", "orders_count", share(F.col("upto"), F.col("total")).alias("cum_pct"))
    )


def order_weight(model: Model) -> DataFrame:
    """Percentage points that one order stands for in its state."""
    return (
        sample(model)
        .groupBy("customer_state")
        .agg(F.count("*").alias("orders_count"))
        .withColumn("points_per_order", share(F.lit(1), F.col("orders_count"), 4))
        .orderBy(F.asc_nulls_last("customer_state"))
    )


def transit_dominates(model: Model, min_share: float = 0.5) -> DataFrame:
    """Orders that spend more than ``min_share`` of their cycle in transit, late and not."""
    dominated = _dominated(min_share)
    return (
        sample(model)
        .groupBy("is_late")
        .agg(
            F.count("*").alias("orders_count"),
            F.count_if(dominated).alias("transit_dominates"),
            share(F.count_if(dominated), F.count("*")).alias("transit_dominates_pct"),
        )
    )


def transit_dominates_by_cycle(model: Model, min_share: float = 0.5) -> DataFrame:
    """The same within strata of equal cycle length, where late and punctual orders can be compared.

    Late orders have longer cycles, and long cycles are mostly transit; a stratum of delivery
    time holds that constant. The weight of a stratum is its share of all orders, late or not.
    """
    number = DELIVERY_BUCKETS.number(F.col("delivery_days")).alias("bucket_no")
    strata = sample(model).groupBy(number, "is_late").agg(
        F.count("*").alias("orders_count"), F.count_if(_dominated(min_share)).alias("transit_dominates")
    )
    weight = share(F.sum("orders_count").over(Window.partitionBy("bucket_no")), F.sum("orders_count").over(all_rows()))
    return strata.withColumn("stratum_pct", weight).orderBy("bucket_no", "is_late").select(
        DELIVERY_BUCKETS.label(F.col("bucket_no")).alias("bucket"), "is_late", "orders_count", "transit_dominates",
        share(F.col("transit_dominates"), F.col("orders_count")).alias("transit_dominates_pct"), "stratum_pct",
    )


def _dominated(min_share: float) -> Column:
    purchase, carrier, received = map(F.col, (PURCHASE, CARRIER, RECEIVED))
    return F.col("transit_days").isNotNull() & (micros(carrier, received) > F.lit(min_share) * micros(purchase, received))


def buffer_by_state(model: Model) -> DataFrame:
    """Days to spare per state."""
    return metrics.buffer(sample(model), "customer_state").orderBy(F.asc_nulls_last("customer_state"))

"""Delivery-SLA metrics over the working sample."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.fixed_values import Period
from punctual.functions import mean, rounded, share
from punctual.functions.times import DAY, micros
from punctual.operators.histogram import all_rows, running
from punctual.operators.percentiles import group_percentile, group_percentiles, percentile
from punctual.operators.sample import APPROVED, CARRIER, PURCHASE, RECEIVED

def late() -> Column:
    """Number of late orders."""
    return F.count_if(F.col("is_late"))


def sample_check(sample: DataFrame) -> DataFrame:
    """One row of control counts: missing dates, broken order, empty stages."""
    return sample.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(APPROVED).isNull()).alias("approved_null"),
        F.count_if(F.col(CARRIER).isNull()).alias("carrier_null"),
        F.count_if(F.col(CARRIER) < F.col(APPROVED)).alias("handover_bad"),
        F.count_if(F.col(RECEIVED) < F.col(CARRIER)).alias("transit_bad"),
        (F.count("*") - F.count("handover_days")).alias("handover_null"),
        (F.count("*") - F.count("transit_days")).alias("transit_null"),
        F.count_if(F.col("approve_hours") < 0).alias("approve_negative"),
    )


def delivery_measures() -> list[Column]:
    """Size, lateness and delivery-time percentiles of a group."""
    spread = percentile(F.col("delivery_days"), 0.5, 0.9)
    return [
        F.count("*").alias("orders_count"),
        late().alias("late_orders_count"),
        share(late(), F.count("*")).alias("late_orders_pct"),
        rounded(spread[0], 2).alias("median_delivery_days"),
        rounded(spread[1], 2).alias("p90_delivery_days"),
    ]


def overview(sample: DataFrame) -> DataFrame:
    """One row: size, lateness and spread of the delivery time."""
    return sample.agg(
        *delivery_measures(),
        mean(F.col("delivery_days")).alias("avg_delivery_days"),
        F.min("delivery_days").alias("min_delivery_days"),
        F.max("delivery_days").alias("max_delivery_days"),
    )


def buffer(sample: DataFrame, *by: str) -> DataFrame:
    """Days to spare of the orders that were on time."""
    spare = -F.col("days_vs_estimate")
    spread = percentile(spare, 0.5, 0.9, 0.1)
    return sample.filter("is_late = false").groupBy(*by).agg(
        F.count("*").alias("on_time_orders"),
        rounded(spread[0], 0).alias("median_buffer"),
        rounded(spread[1], 0).alias("p90_buffer"),
        rounded(spread[2], 0).alias("p10_buffer"),
        F.max(spare).alias("max_buffer"),
    )


def sla_summary(
    sample: DataFrame,
    *by: str,
    promise_digits: int | None = 2,
    cushion: bool = False,
    scored: bool = False,
) -> DataFrame:
    """SLA measures per group.

    ``promise_digits`` None leaves the median promise unrounded. The cushion rounds the
    median promise and the p90 delivery to whole days, then subtracts. ``scored`` adds
    review measures, for a sample joined with one review per order.
    """
    promise = percentile(F.col("promise_days"), 0.5)[0]
    slow = percentile(F.col("delivery_days"), 0.5, 0.9)[1]
    measures = [
        *delivery_measures(),
        (promise if promise_digits is None else rounded(promise, promise_digits)).alias("median_promise_days"),
    ]
    if cushion:
        measures.append((rounded(promise, 0) - rounded(slow, 0)).alias("cushion_days"))
    if scored:
        score = F.col("review_score")
        measures += [
            F.count(score).alias("reviews_count"),
            mean(score).alias("avg_review_score"),
            rounded(percentile(score, 0.5)[0], 2).alias("median_review_score"),
        ]
    return sample.groupBy(*by).agg(*measures)


def cut_curve(sample: DataFrame) -> DataFrame:
    """Late share if the promise were cut by so many days, unordered.

    Cutting n days tips the orders with less than n days to spare. A day that no order
    stands at has no row. Counts per day and lateness give the totals too, so the sample
    is read once.
    """
    late_here = F.when(F.col("is_late"), F.col("orders_count")).otherwise(0)
    counts = (
        sample.groupBy("is_late", (1 - F.col("days_vs_estimate")).alias("cut_days"))
        .agg(F.count("*").alias("orders_count"))
        .withColumn("base", F.sum("orders_count").over(all_rows()))
        .withColumn("late", F.sum(late_here).over(all_rows()))
    )
    on_time = counts.filter("is_late = false").withColumn("will_be_late", running("orders_count", "cut_days"))
    return on_time.select(
        "cut_days",
        "orders_count",
        "will_be_late",
        share(F.col("will_be_late") + F.col("late"), F.col("base")).alias("will_be_late_pct"),
        share(F.col("late"), F.col("base")).alias("late_pct"),
    )


def promise_cut(sample: DataFrame, max_rows: int | None = 7) -> DataFrame:
    """The first days of the cut curve, or with None all of it."""
    curve = cut_curve(sample).drop("late_pct").orderBy("cut_days")
    return curve if max_rows is None else curve.limit(max_rows)


def stage_breakdown(sample: DataFrame, months: Period, point: float = 0.9) -> DataFrame:
    """Percentile of each stage per month, in days, beside the stage's missing values.

    ``months`` starts and ends on the first of a month, so the month filter equals a
    filter on the stored purchase moment, which the scan can use.
    """
    for bound in (months.start, months.end):
        if bound.day != 1:
            raise ValueError(f"not the first of a month: {bound}")
    window = sample.filter(in_months(months.start, months.end))
    counted = window.groupBy("purchase_month").agg(
        F.count("*").alias("orders_count"),
        (F.count("*") - F.count("handover_days")).alias("diff_handover_days_count"),
        (F.count("*") - F.count("transit_days")).alias("diff_transit_days_count"),
        rounded(percentile(F.col("delivery_days"), point)[0], 2).alias("p90_delivery_days"),
    )
    stages = group_percentile(
        window,
        "purchase_month",
        {f"p90_{name}_days": length for name, length in stage_lengths().items()},
        point,
    )
    by_month = stages.groupBy("purchase_month").agg(*(
        rounded(F.max(F.when(F.col("measure") == name, F.col("value"))) / F.lit(float(DAY)), 2).alias(name)
        for name in ("p90_approve_days", "p90_handover_days", "p90_transit_days")
    ))
    return counted.join(by_month, "purchase_month", "left").select(
        "purchase_month",
        "orders_count",
        "p90_approve_days",
        "diff_handover_days_count",
        "p90_handover_days",
        "diff_transit_days_count",
        "p90_transit_days",
        "p90_delivery_days",
    )


def stage_lengths() -> dict[str, Column]:
    """Microseconds of each stage; a stage out of order has none, but for the approval."""
    purchase, approved, carrier, received = map(F.col, (PURCHASE, APPROVED, CARRIER, RECEIVED))
    return {
        "approve": micros(purchase, approved),
        "handover": F.when(carrier >= approved, micros(approved, carrier)),
        "transit": F.when(received >= carrier, micros(carrier, received)),
    }


def stage_spread(sample: DataFrame, *by: str, points: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Percentiles of each stage per group, in days, as columns such as ``p50_transit_days``.

    All points and stages share one histogram of cells, so a group of any size costs counts.
    A group without any stage has no row in the percentiles; its columns are NULL.
    """
    counted = sample.groupBy(*by).agg(F.count("*").alias("orders_count"))
    spread = group_percentiles(sample, by, stage_lengths(), points)
    names = {(name, point): f"p{point * 100:g}_{name}_days" for name in stage_lengths() for point in points}
    wide = spread.groupBy(*by).agg(*(
        rounded(
            F.max(F.when((F.col("measure") == name) & (F.col("point") == point), F.col("value"))) / F.lit(float(DAY)), 2
        ).alias(column)
        for (name, point), column in names.items()
    ))
    same = [counted[key].eqNullSafe(wide[key]) for key in by]
    return counted.join(wide, same, "left").select(*(counted[key] for key in by), "orders_count", *names.values())


def in_months(start: date, end: date) -> Column:
    """Purchase months in ``[start, end)``, as bounds on the month and on the stored moment."""
    month, purchase = F.col("purchase_month"), F.col(PURCHASE)
    return (
        (month >= F.lit(start)) & (month < F.lit(end))
        & (purchase >= F.lit(start).cast("timestamp_ntz")) & (purchase < F.lit(end).cast("timestamp_ntz"))
    )


def score_summary(scored: DataFrame, *by: str, median_digits: int | None = None) -> DataFrame:
    """Score measures per group, for a sample joined with one review per order.

    Shares are of all joined orders, with or without a score; the mean skips NULL scores.
    """
    score = F.col("review_score")
    median = percentile(score, 0.5)[0]
    low = {grade: F.count_if(score == grade) for grade in (1, 2)}
    return scored.groupBy(*by).agg(
        F.count("*").alias("orders_count"),
        mean(score).alias("avg_review_score"),
        (median if median_digits is None else rounded(median, median_digits)).alias("median_review_score"),
        *(
            part
            for grade, n in low.items()
            for part in (
                n.alias(f"orders_with_score_{grade}"),
                share(n, F.count("*")).alias(f"pct_orders_with_score_{grade}"),
            )
        ),
    )

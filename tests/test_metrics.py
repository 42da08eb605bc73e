from datetime import date

import pytest
from pyspark.sql import functions as F

from punctual.fixed_values import Period, WORKING_PERIOD
from punctual.functions.buckets import DELIVERY_BUCKETS
from punctual.operators import metrics
from punctual.operators.histogram import histogram, histogram_of_part
from punctual.operators.sample import delivered_orders
from punctual.plans import sla
from punctual.sources.star_tables import star_model
from tests.conftest import order


def test_sparse_cut_curve(spark):
    frame = spark.createDataFrame([(0, False), (0, False), (-3, False), (5, True), (None, None)],
                                  "days_vs_estimate int, is_late boolean")
    rows = [tuple(r) for r in metrics.promise_cut(frame).collect()]
    assert rows == [(1, 2, 2, 60.0), (4, 1, 3, 80.0)]


def test_cushion_rounds_before_subtracting(spark):
    frame = spark.createDataFrame(
        [("m", False, d, p) for d, p in [(20, 23), (20, 23), (23, 24), (22, 24)]],
        "purchase_month string, is_late boolean, delivery_days int, promise_days int",
    )
    row = metrics.sla_summary(frame, "purchase_month", promise_digits=None, cushion=True).first()
    assert row.median_promise_days == 23.5 and row.p90_delivery_days == 22.7
    assert row.cushion_days == 24 - 23


def test_unscored_group(spark):
    frame = spark.createDataFrame(
        [("s", True, 3, 2, None)],
        "customer_state string, is_late boolean, delivery_days int, promise_days int, review_score int",
    )
    row = metrics.sla_summary(frame, "customer_state", scored=True).first()
    assert (row.reviews_count, row.avg_review_score, row.median_review_score) == (0, None, None)


def test_histogram_invariants(spark, sf_dir):
    sample = sla.sample(star_model(spark, sf_dir)).select("delivery_days", "days_vs_estimate", "is_late").cache()
    total = sample.count()
    rows = histogram(sample, "delivery_days", DELIVERY_BUCKETS).orderBy("bucket_no").collect()
    assert sum(r.orders for r in rows) == total == rows[-1].cum_orders and rows[-1].cum_pct == 100.0
    part = histogram_of_part(sample, "delivery_days", DELIVERY_BUCKETS, "is_late").collect()
    assert sum(r.orders for r in part) == sample.filter("is_late").count()
    sample.unpersist()


def test_missing_handovers_by_inclusion_and_exclusion(spark, sf_dir):
    row = sla.view_check(star_model(spark, sf_dir)).first()
    both = sla.sample(star_model(spark, sf_dir)).filter(
        "order_approved_at is null and order_delivered_carrier_date is null"
    ).count()
    assert row.handover_null == row.handover_bad + row.approved_null + row.carrier_null - both
    assert row.transit_null == row.transit_bad + row.carrier_null


def test_stages(tables):
    sample = delivered_orders(
        tables["orders"](
            order("a", approved="2018-01-02 10:00", carrier="2018-01-03 10:00", received="2018-01-05 10:00"),
            order("b", approved="2018-01-03 10:00", carrier="2018-01-06 10:00", received="2018-01-07 10:00"),
            order("bad", approved="2018-01-03 10:00", carrier="2018-01-02 10:00", received="2018-01-04 10:00"),
            order("next", purchase="2018-02-01 00:00", approved=None, carrier=None, received="2018-02-02 00:00"),
            order("out", purchase="2018-03-01 00:00", received="2018-03-02 00:00"),
        ),
        tables["customers"](),
        WORKING_PERIOD,
    )
    months = Period(date(2018, 1, 1), date(2018, 3, 1))
    rows = {r.purchase_month.month: tuple(r)[1:] for r in metrics.stage_breakdown(sample, months).collect()}
    # approve 1, 2, 2 days; handover 1, 3; transit 2, 1, 2; delivery 4, 6, 3
    assert rows == {1: (3, 2.0, 1, 2.8, 0, 2.0, 5.6), 2: (1, None, 1, None, 1, None, 1.0)}


def test_stage_months_are_whole(tables):
    sample = delivered_orders(tables["orders"](order("a")), tables["customers"](), WORKING_PERIOD)
    with pytest.raises(ValueError):
        metrics.stage_breakdown(sample, Period(date(2018, 1, 2), date(2018, 2, 1)))


def test_promise_share_of_unknown_lateness(tables):
    sample = delivered_orders(
        tables["orders"](order("a", estimate=None), order("b")), tables["customers"](), WORKING_PERIOD
    )
    row = metrics.overview(sample).first()
    assert (row.orders_count, row.late_orders_count, row.late_orders_pct) == (2, 0, 0.0)
    assert metrics.buffer(sample).first().on_time_orders == 1


def test_empty_sample(tables):
    sample = delivered_orders(tables["orders"](order("a", status="shipped")), tables["customers"](), WORKING_PERIOD)
    row = metrics.overview(sample).first()
    assert (row.orders_count, row.late_orders_pct, row.median_delivery_days) == (0, None, None)
    assert metrics.promise_cut(sample).count() == 0
    assert sample.agg(F.count("*")).first()[0] == 0

"""The published results, on the public dataset where a user has it.

Set ``MARKETPLACE_CSV_DIR`` to a folder holding ``<table>.csv`` for each of the tables.
"""

import os

import pytest

from punctual.plans import quality, reviews, sheets, sla
from punctual.sources.files import csv_to_parquet, parquet_model

FOLDER = os.environ.get("MARKETPLACE_CSV_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="the public dataset is not at hand")


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    csv_to_parquet(spark, FOLDER, path)
    return parquet_model(spark, path)


def only(frame):
    (row,) = frame.collect()
    return tuple(row)


def test_quality(model):
    assert all(row.ok for row in quality.row_counts(model).collect())
    order = quality.date_order(model).first()
    assert (order.approved_to_purchase, order.carrier_to_approved, order.carrier_count) == (0, 1359, 97644)
    assert (order.customer_to_carrier, order.customer_count, order.carrier_to_purchase) == (23, 96475, 166)
    assert only(quality.review_repeats(model)) == (99224, 789, 97621, 98126, 547)
    assert only(quality.stuck_age(model)) == (44, 283.0, 315.0, 772)
    assert only(quality.sample_arithmetic(model))[:2] == (96470, 267)
    assert only(quality.median_month_volume(model)) == (20, pytest.approx(4285, abs=0.5))


def test_sla(model):
    assert only(sla.view_check(model)) == (96203, 14, 1, 1350, 19, 1365, 20, 0)
    assert only(sla.overview(model))[:5] == (96203, 6531, 6.79, 10.0, 23.0)
    assert [r.orders for r in sla.delivery_histogram(model).collect()] == [6952, 23708, 37899, 18573, 4824, 3952, 295]
    assert only(sla.buffer(model))[1:] == (13.0, 22.0, 5.0, 147)
    assert [r.will_be_late_pct for r in sla.promise_cut(model).collect()] == [
        8.13, 9.65, 11.26, 13.06, 15.05, 17.36, 21.12,
    ]
    assert [r.p90_transit_days for r in sla.stages(model).collect()] == [23.13, 20.86, 26.81, 28.22, 18.13]
    assert {str(r.purchase_month): r.excess_late for r in sla.excess_late(model).collect()}["2017-11-01"] == 600


def test_reviews(model):
    shares = [(r.review_score, r.orders_count) for r in reviews.score_shares(model).collect()]
    assert shares == [(1, 9314), (2, 2914), (3, 7897), (4, 18843), (5, 56592), (None, 643)]
    bad = {r.is_late: r.bad_reviews_pct for r in reviews.bad_by_lateness(model).collect()}
    assert bad == {False: pytest.approx(9.25, abs=0.011), True: pytest.approx(62.40, abs=0.011)}


def test_sheets(model):
    months = {str(r.purchase_month): r for r in sheets.month_sheet(model).collect()}
    assert len(months) == 20 and months["2018-03-01"].cushion_days == -10.0
    assert sheets.state_sheet(model).count() == 27
    assert {(r.orders_count, r.late_orders_count, r.late_orders_pct, r.agree)
            for r in sheets.reconciliation(model).collect()} == {(96203, 6531, 6.79, True)}

from datetime import date

import pytest
from pyspark.sql import functions as F

from punctual.fixed_values import WORKING_PERIOD
from punctual.operators.sample import VIEW_COLUMNS, create_view, delivered_orders
from tests.conftest import order


@pytest.fixture(scope="module")
def sample(tables):
    frame = delivered_orders(
        tables["orders"](
            order("same day", received="2018-01-10 14:00", estimate="2018-01-10"),
            order("late", received="2018-01-12 00:10", estimate="2018-01-10"),
            order("last day", purchase="2018-08-31 15:00", received="2018-09-05 10:00", estimate="2018-09-20"),
            order("too new", purchase="2018-09-01 00:00", received="2018-09-05 10:00"),
            order("too old", purchase="2016-12-31 23:59", received="2017-01-05 10:00"),
            order("undated", received=None),
            order("shipped", status="shipped"),
            order("carrier first", approved="2018-01-02 12:00", carrier="2018-01-02 11:00"),
            order("carrier equal", approved="2018-01-02 11:00", carrier="2018-01-02 11:00"),
            order("received first", carrier="2018-01-05 13:00", received="2018-01-05 12:00"),
            order("unapproved", approved=None),
            order("no estimate", estimate=None),
            order("approved early", approved="2018-01-01 09:30"),
            order("stranger", customer="nobody"),
            order("no customer", customer=None),
        ),
        tables["customers"](("c1", "SP")),
        WORKING_PERIOD,
    )
    return {row.order_id: row for row in frame.collect()}


def test_kept_orders(sample):
    assert set(sample) == {
        "same day", "late", "last day", "carrier first", "carrier equal", "received first", "unapproved",
        "no estimate", "approved early",
    }


def test_lateness_compares_dates(sample):
    assert (sample["same day"].is_late, sample["same day"].days_vs_estimate) == (False, 0)
    assert (sample["late"].is_late, sample["late"].days_vs_estimate) == (True, 2)
    assert (sample["no estimate"].is_late, sample["no estimate"].days_vs_estimate) == (None, None)


def test_measures(sample):
    row = sample["late"]
    assert row.delivery_days == 11 and row.promise_days == 9
    assert row.cycle_days == pytest.approx(10 + 14 / 24 + 10 / 1440)
    assert row.approve_hours == 1.0 and row.handover_days == 1.0
    assert row.purchase_month == date(2018, 1, 1) and row.customer_state == "SP"


def test_out_of_order_stage_is_empty_but_row_stays(sample):
    assert sample["carrier first"].handover_days is None
    assert sample["carrier equal"].handover_days == 0.0
    assert sample["received first"].transit_days is None and sample["received first"].handover_days is not None
    assert sample["unapproved"].approve_hours is None and sample["unapproved"].handover_days is None
    assert sample["approved early"].approve_hours == -0.5


def test_view(spark, tables):
    frame = delivered_orders(tables["orders"](order("a")), tables["customers"](), WORKING_PERIOD)
    create_view(frame)
    assert tuple(spark.table("delivered_orders").columns) == VIEW_COLUMNS
    assert spark.sql("SELECT count(*) FROM delivered_orders WHERE NOT is_late").first()[0] == 1


def test_unused_places_are_pruned(tables):
    frame = delivered_orders(tables["orders"](order("a")), tables["customers"](), WORKING_PERIOD)
    plan = frame.agg(F.count_if("is_late"))._jdf.queryExecution().optimizedPlan().toString()
    assert "customer_city" not in plan.split("Join")[0]

"""Reconciliation must be able to fail."""

from pyspark.sql import functions as F

from punctual.operators.reconcile import order_totals, reconcile, reconcile_sheets, totals
from punctual.plans import sheets
from punctual.plans.prepared import prepare
from punctual.sources.star_tables import star_model

SHEET = "orders_count bigint, late_orders_count bigint"


def test_an_empty_sheet_disagrees(spark):
    full = spark.createDataFrame([(10, 2)], SHEET)
    rows = reconcile({"flat": full, "month": totals(spark.createDataFrame([], SHEET)), "source": full}).collect()
    assert {(r.check_name, r.orders_count) for r in rows} == {("flat", 10), ("month", 0), ("source", 10)}
    assert not any(r.agree for r in rows)


def test_a_null_total_disagrees(spark):
    rows = reconcile({"a": spark.createDataFrame([(1, 0)], SHEET), "b": spark.createDataFrame([(None, None)], SHEET)}).collect()
    assert [r.agree for r in rows] == [False, False]


def test_an_empty_sample_gives_zeros(spark):
    empty = spark.createDataFrame([], "purchase_month date, customer_state string, is_late boolean")
    rows = reconcile_sheets(empty, empty).collect()
    assert [(r.orders_count, r.late_orders_count, r.agree) for r in rows] == [(0, 0, True)] * 4
    assert order_totals(empty).first().orders_count == 0


def test_a_prepared_sample_that_multiplied_rows_disagrees(spark, sf_dir, tmp_path):
    from dataclasses import replace

    model = star_model(spark, sf_dir)
    good = prepare(model, str(tmp_path / "sample"))
    assert all(r.agree for r in sheets.reconciliation(good).collect())
    bad = replace(good, prepared=lambda: good.prepared().unionByName(good.prepared().filter(F.col("has_review"))))
    assert not any(r.agree for r in sheets.reconciliation(bad).collect())


def test_null_keys_sort_last(spark):
    from punctual.plans import quality
    from punctual.sources.model import Model
    from punctual.sources.schemas import SCHEMAS
    from tests.conftest import order

    orders = spark.createDataFrame([order("a", purchase=None, status="shipped"), order("b", status="shipped")], SCHEMAS["orders"])
    model = Model({"orders": orders}.__getitem__)
    assert [r.month is None for r in quality.orders_by_month(model).collect()] == [False, True]
    assert [r.year for r in quality.stuck_by_year(model).collect()] == [2018, None]

"""Properties of physical plans that matter at scale."""

import pytest

import __spark_entry__ as contract
from punctual.plans import quality, reviews, sheets, sla
from punctual.sources.star_tables import star_model
from tests.conftest import plan_of as plan


@pytest.mark.parametrize("name", contract.queries())
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    text = plan(contract.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize("query", [sla.overview, sla.promise_cut, sla.lateness_histogram])
def test_orders_are_read_once(query, spark, sf_dir):
    assert plan(query(star_model(spark, sf_dir))).count("/orders.parquet") == 1


def test_period_reaches_the_scan(spark, sf_dir):
    text = plan(sla.overview(star_model(spark, sf_dir)))
    assert "GreaterThan(o_orderdate,1995-02-28T00:00)" in text and "LessThan(o_orderdate,2001-08-01T00:00)" in text
    narrow = plan(sla.stages(star_model(spark, sf_dir)))
    assert "GreaterThan(o_orderdate,1997-11-30T00:00)" in narrow


def test_windows_see_counted_rows_only(spark, sf_dir):
    """Below a window that gathers one partition, the first shuffle is of counts."""
    for query in (sla.delivery_histogram, sla.promise_cut, quality.status_shares, reviews.score_shares):
        tree = plan(query(star_model(spark, sf_dir))).split("(1) Scan")[0]
        nodes = [line.split(" (")[0].lstrip(" :+-") for line in tree.splitlines() if " (" in line]
        nodes = [node for node in nodes if node in ("Window", "Exchange", "HashAggregate", "SortMergeJoin")]
        last = next(i for i, node in enumerate(nodes) if node == "Window" and nodes[i + 1] != "Window")
        assert nodes[last + 1:last + 3] == ["Exchange", "HashAggregate"]


def test_reviews_are_limited_before_the_shuffle(spark, sf_dir):
    tree = plan(sheets.order_sheet(star_model(spark, sf_dir))).split("(1) Scan")[0]
    assert tree.count("WindowGroupLimit") == 2


def test_top_rows_need_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(sla.promise_cut(star_model(spark, sf_dir)))

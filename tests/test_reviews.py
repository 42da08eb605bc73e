from pyspark.sql import functions as F

from punctual.fixed_values import WORKING_PERIOD
from punctual.operators.latest import review_per_order
from punctual.operators.reconcile import reconcile_sheets
from punctual.operators.sample import delivered_orders
from punctual.plans import reviews as plans
from punctual.sources.model import Model
from tests.conftest import order


def latest(frame):
    return {row.order_id: row.review_id for row in review_per_order(frame).collect()}


def test_latest_review(tables):
    rows = tables["reviews"](
        ("r1", "null date", 1, None), ("r2", "null date", 5, "2018-01-01"),
        ("a", "tie", 1, "2018-01-01"), ("b", "tie", 2, "2018-01-01"),
        ("x", "later", 1, "2018-01-02"), ("y", "later", 2, "2018-01-01"),
        (None, "null id", 3, "2018-01-01"), ("z", "null id", 4, "2018-01-01"),
    )
    assert latest(rows) == {"null date": "r1", "tie": "b", "later": "x", "null id": None}


def test_one_order_with_most_reviews(spark):
    """A third of the rows on one key: each task keeps one of them before the shuffle."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("order_id"),
        F.col("id").cast("string").alias("review_id"),
        (F.col("id") % 5).cast("int").alias("review_score"),
        F.expr("TIMESTAMP_NTZ '2018-01-01 00:00:00' + id * INTERVAL '1' SECOND").alias("review_creation_date"),
    )
    one = review_per_order(frame)
    assert one.count() == 2001
    assert one.filter("order_id = 'hot'").first().review_id == "2997"
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()


def model(tables, orders, reviews):
    frames = {"orders": orders, "customers": tables["customers"](("c1", "SP"), ("c2", "RJ")), "order_reviews": reviews}
    return Model(frames.__getitem__)


def test_orders_without_review_are_counted_last(tables):
    m = model(
        tables,
        tables["orders"](order("a"), order("b"), order("c"), order("d", customer="c2")),
        tables["reviews"](("r1", "a", 5, "2018-01-06"), ("r2", "a", 1, "2018-01-05"), ("r3", "b", None, "2018-01-06")),
    )
    rows = [tuple(r) for r in plans.score_shares(m).collect()]
    assert rows == [(5, 1, 25.0), (None, 3, 75.0)]


def test_null_score_counts_in_the_base(tables):
    m = model(
        tables,
        tables["orders"](order("a"), order("b")),
        tables["reviews"](("r1", "a", 1, "2018-01-06"), ("r2", "b", None, "2018-01-06")),
    )
    row = plans.scores_by_lateness(m).first()
    assert (row.orders_count, row.avg_review_score, row.pct_orders_with_score_1) == (2, 1.0, 50.0)


def test_reconciliation_keeps_the_join(tables):
    sample = delivered_orders(
        tables["orders"](order("a"), order("b", received="2018-01-25 10:00"), order("c", customer="c2")),
        tables["customers"](("c1", "SP"), ("c2", None)),
        WORKING_PERIOD,
    )
    scores = review_per_order(tables["reviews"](("r1", "a", 5, None), ("r2", "a", 1, None), ("r3", "x", 1, None)))
    result = reconcile_sheets(sample.join(scores, "order_id", "left"), sample)
    assert "LeftOuter" in result._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.check_name: tuple(r)[1:] for r in result.collect()}
    assert rows == dict.fromkeys(
        ["flat table of orders", "total by month", "total by state", "delivered_orders"], (3, 1, 33.33, True)
    )


def test_reconciliation_notices_multiplied_rows(tables):
    sample = delivered_orders(tables["orders"](order("a"), order("b")), tables["customers"](), WORKING_PERIOD)
    twice = tables["reviews"](("r1", "a", 5, None), ("r2", "a", 1, None)).select("order_id", "review_score")
    rows = {r.check_name: r for r in reconcile_sheets(sample.join(twice, "order_id", "left"), sample).collect()}
    assert rows["flat table of orders"].orders_count == 3 and rows["delivered_orders"].orders_count == 2
    assert not any(r.agree for r in rows.values())

"""One key holding a third of the rows, with broadcast joins off."""

import pytest
from pyspark.sql import functions as F

from punctual.operators import constraints, metrics, profile
from punctual.operators.latest import review_per_order
from punctual.operators.sample import delivered_orders
from punctual.fixed_values import WORKING_PERIOD
from tests.conftest import plan_of

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}
ROWS = 60_000


@pytest.fixture(autouse=True)
def small_partitions(spark):
    kept = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in kept.items():
        spark.conf.set(name, value)


def hot_orders(spark):
    """A third of the orders belong to customer 'hot'; order n takes n % 50 days."""
    return spark.range(0, ROWS, 1, 8).selectExpr(
        "CAST(id AS STRING) AS order_id",
        "IF(id % 3 = 0, 'hot', CAST(id % 5000 AS STRING)) AS customer_id",
        "'delivered' AS order_status",
        "TIMESTAMP_NTZ '2018-01-01 10:00:00' AS order_purchase_timestamp",
        "TIMESTAMP_NTZ '2018-01-01 11:00:00' AS order_approved_at",
        "TIMESTAMP_NTZ '2018-01-01 12:00:00' AS order_delivered_carrier_date",
        "TIMESTAMP_NTZ '2018-01-01 12:00:00' + INTERVAL '1' DAY * (id % 50) AS order_delivered_customer_date",
        "TIMESTAMP_NTZ '2018-02-01 00:00:00' AS order_estimated_delivery_date",
    )


def customers(spark):
    return spark.range(0, 5000, 1, 2).selectExpr("CAST(id AS STRING) AS customer_id").union(
        spark.sql("SELECT 'hot' AS customer_id")
    ).selectExpr("customer_id", "customer_id AS customer_state", "customer_id AS customer_city")


def test_hot_customer_is_split(spark):
    sample = delivered_orders(hot_orders(spark), customers(spark), WORKING_PERIOD)
    result = metrics.overview(sample)
    row = result.collect()[0]
    late = sum(1 for n in range(ROWS) if n % 50 > 31)
    assert (row.orders_count, row.late_orders_count, row.max_delivery_days) == (ROWS, late, 49)
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_hot_reference_is_one_row_in_the_join(spark):
    result = constraints.missing_parents(
        hot_orders(spark), "customer_id", customers(spark).filter("customer_id <> 'hot'"), "customer_id"
    )
    assert [tuple(row) for row in result.collect()] == [("hot", ROWS // 3)]


def test_hot_order_in_the_reviews(spark):
    reviews = spark.range(0, ROWS, 1, 8).selectExpr(
        "CAST(id AS STRING) AS review_id",
        "IF(id % 3 = 0, '0', CAST(id AS STRING)) AS order_id",
        "CAST(1 + id % 5 AS INT) AS review_score",
        "TIMESTAMP_NTZ '2018-02-01 00:00:00' + INTERVAL '1' SECOND * id AS review_creation_date",
    )
    sample = delivered_orders(hot_orders(spark), customers(spark), WORKING_PERIOD)
    scored = sample.join(review_per_order(reviews).select("order_id", "review_id", "review_score"), "order_id", "left")
    row = scored.agg(F.count("*").alias("n"), F.count("review_score").alias("scored"),
                     F.max(F.when(F.col("order_id") == "0", F.col("review_id"))).alias("last")).first()
    assert (row.n, row.scored) == (ROWS, ROWS - ROWS // 3 + 1)
    assert row.last == str(ROWS - 3)


def test_hot_group_of_a_distinct_count(spark):
    """Two thirds of the rows are one group's; the rows of a group are dealt by their values first."""
    frame = spark.range(0, ROWS, 1, 8).selectExpr(
        "IF(id % 3 < 2, 'hot', CAST(id % 100 AS STRING)) AS k", "id % 7000 AS a", "IF(id % 2 = 0, NULL, CAST(id % 11 AS STRING)) AS b"
    )
    result = profile.distinct_counts(frame, ["k"], {"a": "a", "b": "b"})
    expected = frame.groupBy("k").agg(F.count("*").alias("rows"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"))
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, expected.collect()))
    plan = plan_of(result)
    # By group, column and value first, and only then by group.
    assert {line.count("#") for line in plan.splitlines() if "hashpartitioning(k" in line} == {1, 3}


def test_distinct_counts_of_odd_groups(spark):
    frame = spark.createDataFrame([(None, None, 1.5), (None, 3, 1.5), ("a", None, None), ("a", None, None)], "k string, x int, y double")
    found = profile.distinct_counts(frame, ["k"], {"x": "x", "y": "y"}).collect()
    assert sorted(map(tuple, found), key=str) == [("a", 2, 0, 0), (None, 2, 1, 1)]
    assert profile.distinct_counts(frame.limit(0), ["k"], {"x": "x"}).collect() == []


def test_batch_reads_only_the_parents_it_may_name(spark):
    """A batch of 600 rows against 60,000 parents: few more than the named ones pass, and orphans are found exactly."""
    parents = spark.range(0, ROWS, 1, 8).selectExpr("CAST(id AS STRING) AS customer_id")
    batch = spark.range(0, 600, 1, 2).selectExpr("IF(id % 3 = 0, 'hot', CAST(id * 150 AS STRING)) AS customer_id").union(
        spark.sql("SELECT CAST(NULL AS STRING) AS customer_id"))
    passed = constraints.batch_parents(batch, "customer_id", parents, "customer_id")
    named = batch.distinct().join(parents, "customer_id").count()
    assert named <= passed.count() <= named + ROWS // 100
    plan = plan_of(passed)
    assert "Join" not in plan and "Exchange" not in plan and "ubquery" in plan
    result = sorted(map(tuple, constraints.missing_parents_of_batch(batch, "customer_id", parents, "customer_id").collect()))
    assert result == sorted(map(tuple, constraints.missing_parents(batch, "customer_id", parents, "customer_id").collect()))
    assert ("hot", 200) in result and len(result) > 100


def test_batch_with_a_filter_far_too_small(spark):
    parents = spark.range(0, 5000).selectExpr("id AS p")
    batch = spark.range(2000, 9000, 1, 2).selectExpr("id AS c")
    found = constraints.missing_parents_of_batch(batch, "c", parents, "p", most_bits=256)
    assert sorted(row.c for row in found.collect()) == list(range(5000, 9000))
    assert constraints.missing_parents_of_batch(batch.limit(0), "c", parents, "p").collect() == []
    with pytest.raises(ValueError, match="differ in type"):
        constraints.missing_parents_of_batch(batch.selectExpr("CAST(c AS INT) AS c"), "c", parents, "p")

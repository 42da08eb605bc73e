from punctual.operators import constraints, profile
from punctual.plans import quality
from punctual.sources.model import Model
from tests.conftest import order


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_repeated_keys(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "x int, y string")
    assert rows(constraints.repeated_keys(frame, ["x", "y"])) == [(1, "a", 2), (2, None, 1)]
    assert rows(constraints.repeated_keys(frame, ["x"])) == [(1, 3)]


def test_null_reference_is_no_orphan(spark):
    child = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "fk string")
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "pk string")
    assert rows(constraints.missing_parents(child, "fk", parent, "pk")) == [("x", 2)]


def test_null_counts(spark):
    frame = spark.createDataFrame([(1, None), (None, None)], "x int, y int")
    assert rows(constraints.null_counts(frame, ["x", "y"])) == [(1, 2)]


def test_multiplicity_counts_null_as_a_key(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(profile.multiplicity(frame, "k")) == [(5, 1, 2)]
    assert rows(profile.multiplicity(frame.limit(0), "k")) == [(0, 0, 0)]


def test_repeat_pattern(tables):
    reviews = tables["reviews"](
        ("spread", "o1", 5, None), ("spread", "o2", 5, None),
        ("same", "o3", 5, None), ("same", "o3", 4, None),
        ("with null", "o4", 4, None), ("with null", None, 4, None),
        ("once", "o5", 3, None),
    )
    assert rows(profile.repeat_pattern(reviews, "review_id", "order_id")) == [("разные заказы", 1), ("тот же заказ", 2)]


def test_chronology_without_eligible_rows(tables):
    model = Model({"orders": tables["orders"](order("a", approved=None, carrier=None, received=None))}.__getitem__)
    assert rows(quality.date_order(model)) == [(0, 0, None, 0, 0, None, 0, 0, None, 0, 0, None)]


def test_chronology(tables):
    model = Model({"orders": tables["orders"](
        order("fine"), order("carrier early", carrier="2017-12-31 10:00"), order("undelivered", received=None)
    )}.__getitem__)
    row = quality.date_order(model).first()
    assert (row.carrier_to_approved, row.carrier_count, row.carrier_to_approved_pct) == (1, 3, 33.333)
    assert (row.customer_to_carrier, row.customer_count) == (0, 2)
    assert (row.carrier_to_purchase, row.carrier_base) == (1, 3)


def test_null_profile_and_distinct_anomalies(tables):
    model = Model({"orders": tables["orders"](
        order("fine"), order("two gaps", carrier=None, received=None), order("one gap", approved=None)
    )}.__getitem__)
    assert rows(quality.missing_dates(model)) == [("delivered", 3, 1, 33.33, 1, 33.33, 1, 33.33)]
    assert rows(quality.anomalous_delivered(model)) == [(1, 1, 1, 2)]


def test_stuck_age_is_in_whole_days(tables):
    model = Model({"orders": tables["orders"](
        order("stuck", purchase="2018-01-01 01:00", status="shipped"),
        order("last", purchase="2018-03-05 00:00"),
    )}.__getitem__)
    assert rows(quality.stuck_age(model)) == [(62, 62.0, 62.0, 62)]


def test_row_counts_say_what_is_missing(spark):
    counts = profile.row_counts({"a": spark.range(3), "b": spark.range(2)}, {"a": 3, "b": 5})
    assert rows(counts) == [("a", 3, 3, True), ("b", 2, 5, False)]


def test_sample_arithmetic_looks_at_undated_orders_for_the_last_purchase(tables):
    model = Model({"orders": tables["orders"](
        order("a"),
        order("old", purchase="2016-12-01 00:00"),
        order("undated", purchase="2018-08-01 00:00", received=None),
    )}.__getitem__)
    row = quality.sample_arithmetic(model).first()
    assert (row.delivered_ok, row.before_period, row.last_purchase.month) == (2, 1, 8)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.functions import rounded
from punctual.operators.percentiles import group_percentile, group_percentiles, percentile


def test_interpolation_skips_null(spark):
    frame = spark.createDataFrame([(1,), (2,), (4,), (None,)], "x int")
    row = frame.agg(percentile(F.col("x"), 0.5, 0.9).alias("p")).select(
        F.col("p")[0], rounded(F.col("p")[1], 6)
    ).first()
    assert tuple(row) == (2.0, 3.6)


def brute(rows, name, point):
    groups = {}
    for key, *values in rows:
        value = values[name]
        if value is not None:
            groups.setdefault(key, []).append(value)
    return {key: float(np.quantile(np.array(v, dtype=float), point)) for key, v in groups.items()}


@pytest.mark.parametrize("point", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_narrowing_equals_brute_force(spark, point):
    """Negative, repeated and missing values, a NULL group, and one group with most rows."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        key = rng.choice(["hot"] * 8 + ["cold", None])
        spread = rng.choice([10, 5_000, 9_000_000])
        rows.append((key, rng.randint(-spread, spread), rng.choice([None, 42, rng.randint(0, 300)])))
    rows += [("single", 17, None), ("pair", -3, 5), ("pair", 4, 5)]
    frame = spark.createDataFrame(rows, "k string, a bigint, b int")
    found = group_percentile(
        frame, "k", {"a": F.col("a"), "b": F.col("b")}, point, widths=(1_000_000, 1_000)
    ).collect()
    for position, name in enumerate(("a", "b")):
        expected = brute(rows, position, point)
        got = {row.k: row.value for row in found if row.measure == name}
        assert got == pytest.approx(expected)


def test_narrowing_without_rows(spark):
    frame = spark.createDataFrame([("k", None)], "k string, a bigint")
    assert group_percentile(frame, "k", {"a": F.col("a")}, 0.5).count() == 0


def test_several_points_and_keys_equal_brute_force(spark):
    """Two keys, NULL among them, four points at once, one group with most rows, single values and ties."""
    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        key = (rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([1, 1, 1, 2, None]))
        rows.append((*key, rng.randint(-9_000_000, 9_000_000), rng.choice([None, 42, rng.randint(0, 300)])))
    rows += [("single", 1, 17, None), ("pair", 1, -3, 5), ("pair", 1, 4, 5), ("none", 1, None, None)]
    frame = spark.createDataFrame(rows, "k string, j int, a bigint, b int")
    points = [0.0, 0.1, 0.5, 0.9]
    found = group_percentiles(frame, ["k", "j"], {"a": F.col("a"), "b": F.col("b")}, points, widths=(1_000_000, 1_000)).collect()
    for position, name in enumerate(("a", "b")):
        for point in points:
            expected = brute([((k, j), *values) for k, j, *values in rows], position, point)
            assert {(row.k, row.j): row.value for row in found if (row.measure, row.point) == (name, point)} == pytest.approx(expected)


def test_several_points_share_their_passes(spark):
    """More points add no aggregate and no join."""
    frame = spark.range(1000).selectExpr("id % 3 AS k", "id AS a")

    def joins(*points):
        text = group_percentiles(frame, ["k"], {"a": F.col("a")}, points)._jdf.queryExecution().sparkPlan().toString()
        return text.count("Join"), text.count("HashAggregate")

    assert joins(0.5) == joins(0.1, 0.5, 0.9, 0.99)

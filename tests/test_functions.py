import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from punctual.functions import Buckets, elapsed, mean, month_of, ratio, rounded, share, whole_days
from punctual.functions.buckets import DELIVERY_BUCKETS, LATENESS_BUCKETS
from punctual.functions.times import micros
from tests.conftest import moment


@pytest.mark.parametrize("n, d, digits, expected", [
    (1, 800, 2, 0.13),       # 0.125 is a tie: away from zero
    (-1, 800, 2, -0.13),
    (1, 3, 2, 33.33),
    (2, 3, 3, 66.667),
    (0, 7, 2, 0.0),
    (5, 0, 2, None),
    (None, 4, 2, None),
    (10**12 - 1, 10**12, 2, 100.0),
])
def test_share(spark, n, d, digits, expected):
    frame = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    assert frame.select(share(F.col("n"), F.col("d"), digits)).first()[0] == expected


def test_shares_equal_decimal_arithmetic(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, d), d) for d in (rng.randint(1, 10**rng.randint(1, 12)) for _ in range(500))]
    frame = spark.createDataFrame(pairs, "n bigint, d bigint")
    for digits in (0, 2, 3):
        for n, d, got in frame.select("n", "d", share(F.col("n"), F.col("d"), digits)).collect():
            exact = Fraction(100 * n, d) * 10**digits
            assert got == math.floor(exact + Fraction(1, 2)) / 10**digits


def test_ratio_and_mean(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,), (2,)], "x int")
    assert frame.agg(mean(F.col("x"))).first()[0] == 1.67
    assert frame.filter("x is null").agg(mean(F.col("x"))).first()[0] is None
    assert frame.select(ratio(F.lit(7), F.lit(2), 0)).first()[0] == 4.0


@pytest.mark.parametrize("value, digits, expected", [(1.005, 2, 1.01), (12.5, 0, 13.0), (-12.5, 0, -13.0)])
def test_rounded(spark, value, digits, expected):
    assert spark.range(1).select(rounded(F.lit(value), digits)).first()[0] == expected


def numbers(spark, buckets, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    return [r[0] for r in frame.orderBy("i").select(buckets.number(F.col("v"))).collect()]


def test_bucket_edges(spark):
    values = [0, 3, 4, 7, 8, 14, 15, 23, 24, 30, 31, 60, 61, -1, None]
    assert numbers(spark, DELIVERY_BUCKETS, values) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 1, 7]


def test_lateness_bucket_is_closed_below(spark):
    assert numbers(spark, LATENESS_BUCKETS, [1, 3, 0, -5]) == [1, 1, 7, 7]
    assert LATENESS_BUCKETS.labels()[0] == "1-3"


def test_bucket_labels_and_widths(spark):
    assert Buckets(suffix=" d").labels() == ["0-3 d", "4-7 d", "8-14 d", "15-23 d", "24-30 d", "31-60 d", "61+ d"]
    frame = spark.createDataFrame([(n,) for n in range(1, 8)], "n int").orderBy("n")
    widths = [r[0] for r in frame.select(DELIVERY_BUCKETS.width(F.col("n"), F.lit(210))).collect()]
    assert widths == [4, 4, 7, 9, 7, 30, 150]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_durations_ignore_the_session_time_zone(spark, zone):
    """The clocks changed between these two moments in Sao Paulo."""
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.sql(
            "SELECT TIMESTAMP_NTZ '1998-02-25 10:00:00.000001' AS a, TIMESTAMP_NTZ '1998-03-05 10:00:00.25' AS b"
        )
        forth, back, days, month = frame.select(
            micros(F.col("a"), F.col("b")), micros(F.col("b"), F.col("a")),
            elapsed(F.col("a"), F.col("b")), month_of(F.col("b")),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert forth == -back == 8 * 86_400_000_000 + 249_999
    assert days == forth / 86_400e6 and str(month) == "1998-03-01"


def test_whole_days_truncates(spark):
    frame = spark.createDataFrame(
        [(moment("2018-01-01 01:00"), moment("2018-03-04 00:00"))], "a timestamp_ntz, b timestamp_ntz"
    )
    assert frame.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 61
    assert frame.select(whole_days(F.col("b"), F.col("a"))).first()[0] == -61

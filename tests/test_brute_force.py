"""Random small samples against plain Python."""

import math
import random
from collections import Counter

import pytest

from punctual.functions.buckets import DELIVERY_BUCKETS, LATENESS_BUCKETS
from punctual.operators import metrics
from punctual.operators.histogram import histogram, histogram_of_part

EDGES = (3, 7, 14, 23, 30, 60)


def half_up(n, d, digits=2):
    scale = 10**digits
    return math.floor((2 * n * scale + d) / (2 * d)) / scale if d else None


def place(value, closed):
    if value is None or (closed and value < 1):
        return 7
    return next((i for i, edge in enumerate(EDGES, start=1) if value <= edge), 7)


@pytest.fixture(scope="module", params=[3, 11])
def rows(request):
    rng = random.Random(request.param)
    out = []
    for _ in range(400):
        against = rng.choice([None, *range(-40, 80)])
        out.append((against, None if against is None else against > 0, rng.choice([None, *range(-1, 90)])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "days_vs_estimate int, is_late boolean, delivery_days int")


def test_histogram(rows, frame):
    counts = Counter(place(days, closed=False) for _, _, days in rows)
    upto, expected = 0, []
    for number in sorted(counts):
        upto += counts[number]
        expected.append((number, counts[number], half_up(100 * counts[number], 400), upto, half_up(100 * upto, 400)))
    got = histogram(frame, "delivery_days", DELIVERY_BUCKETS).drop("bucket").orderBy("bucket_no").collect()
    assert [tuple(row) for row in got] == expected


def test_histogram_of_late(rows, frame):
    counts = Counter(place(against, closed=True) for against, late, _ in rows if late)
    total, upto, expected = sum(counts.values()), 0, []
    for number in sorted(counts):
        n = counts[number]
        upto += n
        expected.append((number, n, half_up(100 * n, total), upto, half_up(100 * upto, total), half_up(100 * n, 400)))
    got = histogram_of_part(frame, "days_vs_estimate", LATENESS_BUCKETS, "is_late").drop("bucket").orderBy("bucket_no")
    assert [tuple(row) for row in got.collect()] == expected


def test_promise_cut(rows, frame):
    late = sum(1 for _, is_late, _ in rows if is_late)
    counts = Counter(1 - against for against, is_late, _ in rows if is_late is False)
    upto, expected = 0, []
    for cut in sorted(counts):
        upto += counts[cut]
        expected.append((cut, counts[cut], upto, half_up(100 * (upto + late), 400)))
    assert [tuple(row) for row in metrics.promise_cut(frame, None).collect()] == expected
    assert [tuple(row) for row in metrics.promise_cut(frame).collect()] == expected[:7]

"""Near duplicates among embeddings against all pairs."""

import numpy as np
import pytest

from punctual.llm import cap_filters as caps

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """Links and components of all pairs, in the order of the rows."""
    def usable(x):
        return x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)

    n = len(rows)
    linked = np.zeros((n, n), bool)
    for size in {len(x) for _, x in rows if usable(x)}:
        at = [i for i, (_, x) in enumerate(rows) if usable(x) and len(x) == size]
        units = np.array([rows[i][1] for i in at], np.float32).astype(np.float64)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        linked[np.ix_(at, at)] = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        root[find(i)] = find(j)
    least = {}
    for i in range(n):
        ids = [x for x in (rows[i][0], least.get(find(i))) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(rows[i][0], int(linked[i].sum()), least[find(i)], rows[i][0] == least[find(i)]) for i in range(n)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def found(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, caps.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=key)


def noisy(draw, centre, count, noise):
    own = centre + noise * draw.standard_normal((count, len(centre))) / np.sqrt(len(centre))
    return own / np.linalg.norm(own, axis=1, keepdims=True) * draw.uniform(0.5, 3, (count, 1))


def test_tight_and_loose_groups_copies_and_strangers(spark):
    draw = np.random.default_rng(5)
    parts = [draw.standard_normal((400, 48))]
    for noise, count in ((0.05, 300), (0.12, 60), (0.2, 40), (0.24, 60), (0.3, 60)):
        parts.append(noisy(draw, parts[0][len(parts)] / np.linalg.norm(parts[0][len(parts)]), count, noise))
    parts.append(np.repeat(parts[0][20:22], 150, axis=0))
    every = np.concatenate(parts).astype(np.float32)
    rows = [(int(i), [float(x) for x in every[k]]) for k, i in enumerate(draw.permutation(len(every)))]
    expected = sorted(plain(rows), key=key)
    result = found(spark, rows)
    # No link is made up, and of links at cosines around the bar fewer than one in a hundred is missed.
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(result, expected))
    assert sum(a[1] for a in result) >= 0.99 * sum(b[1] for b in expected) > 0
    assert sum(a[2] == b[2] for a, b in zip(result, expected)) >= 0.99 * len(rows)


@pytest.mark.parametrize("cosine, share", [(0.9501, 0.99), (0.97, 0.995), (0.99, 0.999)])
@pytest.mark.parametrize("dimension", [64, 300])
def test_recall_of_the_filters(cosine, share, dimension):
    """Pairs at a cosine share a filter, with as many directions as 50,000 vectors ask for."""
    draw = np.random.default_rng(1)
    codes = caps.Codes(dimension, 50_000)
    one = caps._units(draw.standard_normal((1500, dimension)))
    other = draw.standard_normal((1500, dimension))
    other = caps._units(other - (other * one).sum(1, keepdims=True) * one)
    two = cosine * one + np.sqrt(1 - cosine**2) * other
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(codes.filters(one), codes.filters(two))]
    assert np.mean(met) >= share
    apart = [int(x).bit_count() for x in (caps._signs(one, 50_000) ^ caps._signs(two, 50_000)).view(np.uint64)]
    assert max(apart) <= caps._differing(caps._ANGLE)


def test_all_directions_over_the_bar_are_found():
    code = caps.ProductCode(24, 9000, 1)
    units = caps._units(np.random.default_rng(3).standard_normal((40, 24)))
    for vector, own in zip(units, code.directions(units)):
        parts = [x[0] for x in code.products(vector[None])]
        sums = parts[0]
        for part in parts[1:]:
            sums = (sums[:, None] + part).ravel()
        over = np.flatnonzero(sums >= code.bar)
        assert sorted(own) == sorted(set(over) | (set(np.argsort(-sums)[: caps.LEAST]) if len(over) < caps.LEAST else set()))


def test_balls_that_meet_are_verified_vector_by_vector(spark):
    """Two balls whose members are partly linked, and more members than one tile has."""
    draw = np.random.default_rng(8)
    axis = np.eye(16)
    parts = []
    for angle in (0.0, 0.25, 0.62):
        centre = np.cos(angle) * axis[0] + np.sin(angle) * axis[1]
        parts.append(noisy(draw, centre, 330, 0.11))
    every = np.concatenate(parts).astype(np.float32)
    rows = [(int(i), [float(x) for x in every[k]]) for k, i in enumerate(draw.permutation(len(every)))]
    expected = sorted(plain(rows), key=key)
    result = found(spark, rows)
    assert all(a[1] <= b[1] for a, b in zip(result, expected))
    assert sum(a[1] for a in result) >= 0.995 * sum(b[1] for b in expected)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
            (None, [2.0, 0.0]), (None, [0.0, 1.0]), (8, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0]), (11, [-1.0, 0.0]), (None, None),
            (12, [1e-30, 0.0]), (13, [3e38, 1e38])]
    expected = sorted([(a, b, c, a == c) for a, b, c, _ in plain(rows)], key=key)
    assert found(spark, rows) == expected
    wide = [(*row, 5, b"x", 0.5) for row in rows]
    assert found(spark, wide, f"{SCHEMA}, id long, key binary, cosine double") == expected
    assert found(spark, [], SCHEMA) == []
    assert found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.1])], "vec_id long, embedding array<double>") == [(1, 1, 1, True), (2, 1, 1, False)]

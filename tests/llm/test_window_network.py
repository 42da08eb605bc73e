"""The window network's scores and steps against a plain softmax in double precision."""

import numpy as np
import pytest

from punctual.llm import pseudo_likelihood as window


def plain_log_softmax(logits):
    logits = logits - logits.max()
    return logits - np.log(np.exp(logits).sum())


def plain_score(arrays, own, around):
    tables, bias, into, into_bias, within, within_bias = arrays
    hidden = np.tanh(sum((tables[k][around[k]] for k in range(2 * window.SIDE)), bias))
    group, place = divmod(int(own), window.CLASS)
    return plain_log_softmax(hidden @ into + into_bias)[group] + plain_log_softmax(hidden @ within[group] + within_bias[group])[place]


@pytest.fixture
def windows():
    random = np.random.default_rng(4)
    return random.integers(0, window.WORDS, 5000), random.integers(0, window.WORDS + 1, (2 * window.SIDE, 5000))


@pytest.fixture
def network():
    network = window.Network.started(np.full(window.WORDS, 1 / window.WORDS))
    for array in network.arrays:
        array *= 5
    return network


def test_scores_equal_a_plain_softmax(network, windows):
    ids, sides = windows
    found, arrays = network.scores(ids, sides), [array.astype(np.float64) for array in network.arrays]
    for i in range(0, 5000, 250):
        assert found[i] == pytest.approx(plain_score(arrays, ids[i], sides[:, i]), rel=1e-4)
    # A few at a time or all at once.
    assert network.scores(ids[4000:], sides[:, 4000:]) == pytest.approx(found[4000:], rel=1e-4)
    assert len(network.scores(ids[:1], sides[:, :1])) == 1


def test_a_step_goes_down_the_numeric_gradient(network, windows):
    ids, sides = windows[0][:40], windows[1][:, :40]
    arrays = [array.astype(np.float64) for array in network.arrays]
    mean = lambda: np.mean([plain_score(arrays, ids[i], sides[:, i]) for i in range(40)])
    squares = [np.zeros_like(array) for array in network.arrays]
    network.learn(ids, sides, squares)
    # The first step's squares are those of the gradient.
    group, place = divmod(int(ids[0]), window.CLASS)
    for at, index in ((0, (0, sides[0, 0], 3)), (0, (3, sides[3, 7], 1)), (1, (5,)), (2, (2, group)), (3, (group,)), (4, (group, 4, place)), (5, (group, place))):
        start = arrays[at][index]
        arrays[at][index] = start + 1e-5
        above = mean()
        arrays[at][index] = start - 1e-5
        slope = (above - mean()) / 2e-5
        arrays[at][index] = start
        assert squares[at][index] == pytest.approx(slope * slope, rel=1e-2, abs=1e-9)
        assert (network.arrays[at][index] - start) * slope >= 0

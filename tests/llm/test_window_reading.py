"""The window network reads, sums and learns many tokens at once as it would one by one."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from punctual.llm import pseudo_likelihood as window
from punctual.llm.shingles import words_of

TEXTS = [
    b"the cat The\tdog\x0b\x0cthe\r\nthem\xc3\x89", None, b"", b" \x0b\n ", b" a\0b c\0 \0 \xff\xfe\x85x \x1cy ",
    b"x" * 70 + b" cat " + bytes(range(33, 256)), b"thethethe cats", b"the",
]


def texts_of(rows, kind=None):
    return pa.array(rows, kind or pa.binary())


@pytest.fixture
def model():
    parts = [b"the\0", b"cat\0", b"a\0", b"th", b"the", b"them", b"he", b"s\0", b"x\0", b"\0b", b"\xc3\xa9", b"xx", b"xxxx"]
    return window.Model(parts, window.Network.started(np.full(window.WORDS, 1 / window.WORDS)))


@pytest.mark.parametrize("together", [1, 3, 1 << 15])
@pytest.mark.parametrize("parted", [1, 40, 1 << 23])
@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_texts_read_together_are_those_read_word_by_word(model, monkeypatch, together, parted, kind):
    monkeypatch.setattr(window, "WINDOWS", together)
    monkeypatch.setattr(window, "PARTED", parted)
    parts = list(model.read_all(texts_of(TEXTS, kind)))
    one_by_one = [model.read(words_of(text)) for text in TEXTS]
    assert np.array_equal(np.concatenate([x[0] for x in parts]), np.concatenate([x[0] for x in one_by_one]))
    assert np.array_equal(np.concatenate([x[1] for x in parts], axis=1), np.concatenate([x[1] for x in one_by_one], axis=1))
    assert np.concatenate([x[2] for x in parts]).tolist() == [len(x[0]) for x in one_by_one]
    assert np.concatenate([x[3] for x in parts]).tolist() == [len(words_of(text)) for text in TEXTS]
    assert sum(len(x[0]) for x in model.read_all(texts_of([None, b"", b" "]))) == 0
    assert not list(model.read_all(texts_of([])))


def test_only_long_words_are_worked_out_one_by_one(model, monkeypatch):
    asked, missing = [], window.Tokens.__missing__
    monkeypatch.setattr(window.Tokens, "__missing__", lambda self, word: asked.append(word) or missing(self, word))
    random = np.random.default_rng(6)
    words = [bytes(random.integers(97, 123, random.integers(1, 12)).astype(np.uint8)) for _ in range(3000)] + [b"long" * 30]
    batch = pa.RecordBatch.from_arrays([texts_of([b" ".join(words)])], names=["text"])
    found = np.concatenate([ids for ids, _ in window._windows(model, iter([batch]))])
    assert asked == [b"long" * 30]
    assert np.array_equal(found, model.read(words)[0])


def test_words_and_pieces_are_counted_as_one_by_one(monkeypatch):
    monkeypatch.setattr(window, "PARTED", 30)
    monkeypatch.setattr(window, "COUNTED", 5)
    batch = pa.RecordBatch.from_arrays([texts_of(TEXTS)], names=["text"])
    found = collections.Counter()
    for part in window._counted(iter([batch, batch])):
        for word, n in zip(*(column.to_pylist() for column in part.columns), strict=True):
            found[word] += n
    words = collections.Counter(word for text in TEXTS for word in words_of(text) for _ in range(2))
    assert found == words
    counts = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()))], names=["word", "tokens"])
    for known in (set(), {b"the"}, set(words)):
        found, expected = collections.Counter(), collections.Counter()
        for part in window._pieced(known)(iter([counts])):
            for piece, n in zip(*(column.to_pylist() for column in part.columns), strict=True):
                found[window._piece(piece)] += n
        for word, n in words.items():
            whole = word + b"\0"
            for length in window.LENGTHS if word not in known else ():
                for i in range(len(whole) - length + 1):
                    expected[whole[i : i + length]] += n
        assert {k.lstrip(b"\0"): n for k, n in found.items() if k[:1] != b"\0"} == {k: n for k, n in expected.items() if k[:1] != b"\0"}


def test_rows_of_a_place_add_up():
    random = np.random.default_rng(7)
    for size in (1, 2, 500):
        flat = window._flat(random.zipf(1.4, (2 * window.SIDE, size)) % (window.WORDS + 1))
        rows = random.normal(size=(size, window.HIDDEN)).astype(np.float32)
        places, found = window._summed(rows, flat)
        expected = np.zeros((2 * window.SIDE * (window.WORDS + 1), window.HIDDEN))
        for around in flat:
            np.add.at(expected, around, rows)
        assert sorted(places.tolist()) == sorted(set(flat.ravel().tolist()))
        assert found == pytest.approx(expected[places], rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("by", [1, 40])
def test_logits_of_any_size_score_and_learn_as_in_double_precision(by):
    network = window.Network.started(np.full(window.WORDS, 1 / window.WORDS))
    # The second makes logits whose exponentials leave single precision.
    for array in network.arrays[2:]:
        array *= by
    network.arrays[3][:] += np.linspace(0, 3 * by, window.CLASSES)
    assert any(map(window._wide, network.biased())) == (by > 1)
    random = np.random.default_rng(8)
    ids, sides = random.integers(0, window.WORDS, 600), random.integers(0, window.WORDS + 1, (2 * window.SIDE, 600))
    tables, bias, into, into_bias, within, within_bias = (array.astype(np.float64) for array in network.arrays)
    hidden = np.tanh(sum((tables[k][sides[k]] for k in range(2 * window.SIDE)), bias))
    group, place, rows = ids // window.CLASS, ids % window.CLASS, np.arange(len(ids))
    outer, inner = hidden @ into + into_bias, np.einsum("ij,ijk->ik", hidden, within[group]) + within_bias[group]
    outer, inner = (x - x.max(axis=1, keepdims=True) for x in (outer, inner))
    outer, inner = (x - np.log(np.exp(x).sum(axis=1, keepdims=True)) for x in (outer, inner))
    assert network.scores(ids, sides) == pytest.approx(outer[rows, group] + inner[rows, place], rel=1e-3, abs=1e-3)
    squares = [np.zeros_like(array) for array in network.arrays]
    network.learn(ids, sides, squares)
    gap = np.exp(outer)
    gap[rows, group] -= 1
    assert np.sqrt(squares[2]) == pytest.approx(np.abs(hidden.T @ gap / len(ids)), rel=1e-2, abs=1e-5)
    assert np.sqrt(squares[3]) == pytest.approx(np.abs(gap.mean(axis=0)), rel=1e-2, abs=1e-5)
    assert all(np.isfinite(array).all() for array in network.arrays)

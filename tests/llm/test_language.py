"""The language model against a plain learner, its features against plain n-grams, and its sample."""

import math

import numpy as np
from pyspark.sql import functions as F

from punctual.llm import language


def plain_cells(text):
    """Each run of one to three characters, hashed on its own."""
    found = {}
    data = [ord(c) for c in f" {text.lower()} "]
    for size in language.GRAMS:
        for start in range(len(data) - size + 1):
            code = size
            for c in data[start : start + size]:
                code = (code * 0x9E3779B1 + c) % 2**32
            code ^= code >> 15
            code = code * 0x85EBCA77 % 2**32
            cell = code >> (32 - language.CELLS.bit_length() + 1)
            found[cell] = found.get(cell, 0) + 1
    return found


def test_features_are_of_characters():
    for text in ("Añb", "日本語", "", "é😀 é😀", "x" * 50):
        counts = language.cells_of(text)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == plain_cells(text)


def plain_weights(rows, languages):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n, bias = {}, {}, [0.0] * languages

    def weight(key):
        a = z.get(key, 0.0)
        if abs(a) <= language.L1:
            return 0.0
        return -(a - math.copysign(language.L1, a)) / ((language.BETA + math.sqrt(n.get(key, 0.0))) / language.ALPHA + language.L2)

    for _ in range(language.PASSES):
        for cells, values, label in rows:
            logits = [sum(v * weight((c, k)) for c, v in zip(cells, values)) + bias[k] for k in range(languages)]
            powers = [math.exp(x - max(logits)) for x in logits]
            gaps = [p / sum(powers) - (k == label) for k, p in enumerate(powers)]
            old = {(c, k): weight((c, k)) for c in cells for k in range(languages)}
            for c, v in zip(cells, values):
                for k, gap in enumerate(gaps):
                    g, key = v * gap, (c, k)
                    step = (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / language.ALPHA
                    z[key] = z.get(key, 0.0) + g - step * old[key]
                    n[key] = n.get(key, 0.0) + g * g
            bias = [b - 0.01 * gap for b, gap in zip(bias, gaps)]
    return {key: weight(key) for key in z}


def test_weights_equal_a_plain_learner():
    texts = ["the cat sat", "der hund lief", "le chat dort", "the dog ran", "die katze", "un chien court", "a cat", "ein hund", "des chats"] * 2
    rows = []
    for i, text in enumerate(texts):
        counts = language.cells_of(text)
        cells = np.flatnonzero(counts)
        rows.append((i, cells.astype(np.int32), counts[cells], i % 3))
    model = language.Model(["de", "en", "fr"], rows)
    # The same rows in the model's order, without those kept for the temperature.
    order = sorted(rows, key=lambda row: language.xxhash.xxh64_intdigest(str(row[0])))[len(rows) // 5 :]
    vectors = []
    for _, cells, counts, label in order:
        values = np.log1p(counts) * model.idf[cells]
        vectors.append((cells.tolist(), (values / np.sqrt((values * values).sum())).tolist(), label))
    expected = plain_weights(vectors, 3)
    found = {(int(c), int(k)): float(model.weights[c, k]) for c, k in zip(*np.nonzero(model.weights))}
    assert {key for key, w in expected.items() if abs(w) > 1e-4} <= set(found)
    assert all(abs(w - expected.get(key, 0.0)) < 1e-3 for key, w in found.items()) and len(found) > 50


def test_every_language_is_learnt_from_a_bounded_sample(spark):
    """Two hundred languages of which one has most rows; each has its own letters."""
    rows = [(i, f"l{i % 200:03}" if i < 8000 else "l000", chr(0x4E00 + (i % 200 if i < 8000 else 0)) * (3 + i % 5)) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.trained(docs, F.lit(True), sample=2000)
    assert len(model.languages) == 200
    found = language.languages(docs.where("doc_id < 400"), model).join(docs, "doc_id").collect()
    assert sum(row.lang == row.lang_pred for row in found) >= 0.97 * len(found)
    picked = docs.groupBy("lang").count().collect()
    assert len(picked) == 200


def test_ties_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "xx yy"), (2, "b", "xx yy"), (None, "a", "xx"), (3, None, "zz"), (4, "b", None), (1, "a", "xx yy")],
                                 "doc_id long, lang string, text string").withColumns({name: F.lit(0) for name in ("score", "lang_pred", "cells", "count")})
    model = language.trained(docs, F.lit(True))
    found = {(row.doc_id, row.lang_pred) for row in language.languages(docs, model).collect()}
    assert {pred for _, pred in found} <= {"a", "b", "und"} and (4, "und") in found and language.languages(docs, model).count() == 6
    assert language.languages(docs.limit(0), model).count() == 0

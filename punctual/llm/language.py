"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams of a text's characters are hashed to a fixed number of cells. The weights are learnt on a
bounded sample by follow-the-regularised-leader with elastic-net penalties, which leaves most of
them exactly zero; a temperature, fitted on rows of the sample that the weights never saw, makes
the probabilities honest.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.store import sent

#: Rows that train in all, picked by a hash of the id, the same number of each language; of one language at least so many.
SAMPLE, FEWEST = 6000, 20
#: Characters of an n-gram, and cells they are hashed to.
GRAMS, CELLS = (1, 2, 3), 1 << 14
#: Learning: passes, step scale, smoothing, L1 and L2 penalties.
PASSES, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01

_LETTER = re.compile(r"[^\W\d_]").search


def cells_of(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased text's characters."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(CELLS, np.float32)
    for size in GRAMS:
        ends = len(data) - size + 1
        if ends <= 0:
            break
        codes = np.full(ends, size, np.uint32)
        for step in range(size):
            codes *= np.uint32(0x9E3779B1)
            codes += data[step : step + ends]
        codes ^= codes >> np.uint32(15)
        codes *= np.uint32(0x85EBCA77)
        counts += np.bincount(codes >> np.uint32(32 - CELLS.bit_length() + 1), minlength=CELLS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of one text, of unit length."""
    values = np.log1p(counts) * idf
    size = np.sqrt((values * values).sum())
    return values / size if size > 0 else values


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], rows: list[tuple[int, np.ndarray, np.ndarray, int]]):
        """rows: id, cells, counts, number of the language; one row in five is kept for the temperature."""
        self.languages = languages
        rows = sorted(rows, key=lambda row: xxhash.xxh64_intdigest(str(row[0])))
        seen = np.zeros(CELLS)
        for _, cells, _, _ in rows:
            seen[cells] += 1
        self.idf = (1 + np.log((1 + len(rows)) / (1 + seen))).astype(np.float32)
        self.weights = np.zeros((CELLS, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature = 1.0
        vectors = []
        for _, cells, counts, label in rows:
            values = np.log1p(counts) * self.idf[cells]
            vectors.append((cells, (values / np.sqrt((values * values).sum())).astype(np.float32), label))
        if len(languages) > 1:
            self._learn(vectors[len(vectors) // 5 :])
            self._cool(vectors[: len(vectors) // 5])

    def _learn(self, vectors) -> None:
        shape = (CELLS, len(self.languages))
        z, n = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        for _ in range(PASSES):
            for cells, values, label in vectors:
                own_z, own_n = z[cells], n[cells]
                active = np.abs(own_z) > L1
                w = np.where(active, -(own_z - np.sign(own_z) * L1) / ((BETA + np.sqrt(own_n)) / ALPHA + L2), 0)
                gap = softmax(values @ w + self.bias)
                gap[label] -= 1
                g = values[:, None] * gap
                step = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
                z[cells] += g - step * w
                n[cells] += g * g
                self.bias -= 0.01 * gap
        active = np.abs(z) > L1
        self.weights = np.where(active, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0).astype(np.float32)

    def _cool(self, vectors) -> None:
        if not vectors:
            return
        logits = np.array([values @ self.weights[cells] + self.bias for cells, values, _ in vectors])
        labels = np.array([label for _, _, label in vectors])

        def loss(temperature: float) -> float:
            scaled = logits / temperature
            scaled = scaled - scaled.max(axis=1, keepdims=True)
            chances = scaled - np.log(np.exp(scaled).sum(axis=1, keepdims=True))
            # One row more of each language than was seen, as no sample proves certainty.
            doubt = 1 / (len(labels) + chances.shape[1])
            return -float((1 - doubt) * chances[np.arange(len(labels)), labels].mean() + doubt * chances.mean())

        self.temperature = min(np.geomspace(0.02, 5, 120), key=loss)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability."""
        if text is None or not self.languages or not _LETTER(text):
            return "und", 0.0
        values = weighted(cells_of(text), self.idf)
        chances = softmax((values @ self.weights + self.bias) / self.temperature)
        best = int(np.argmax(chances))
        return self.languages[best], float(min(1.0, chances[best]))


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max())
    return powers / powers.sum()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [cells_of(text or "") for text in batch.column(1).to_pylist()]
        cells = [np.flatnonzero(x) for x in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(cells, pa.list_(pa.int64())),
             pa.array([x[at] for x, at in zip(found, cells, strict=True)], pa.list_(pa.float32()))],
            names=["doc_id", "lang", "cells", "counts"],
        )


def trained(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Model learnt from text and lang of the rows that ``usable`` (over doc_id) admits.

    About ``sample`` rows train in all, whole texts picked by a hash of the id, and as many of each
    language; every language that occurs is learnt, from ``FEWEST`` rows at least if it has so many.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    totals = rows.groupBy("lang").count().collect()
    languages = sorted(row["lang"] for row in totals)
    if not languages:
        return Model([], [])
    rates = F.create_map(*[F.lit(x) for row in totals for x in (row["lang"], row["count"])])
    each = max(FEWEST, sample // len(languages))
    picked = rows.where(
        F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.element_at(rates, F.col("lang"))) < each
    ).select("doc_id", "text", "lang")
    found = picked.mapInArrow(_sampled, "doc_id long, lang string, cells array<long>, counts array<float>").toArrow()
    number = {language: i for i, language in enumerate(languages)}
    columns = [found.column(name).combine_chunks() for name in ("doc_id", "lang", "cells", "counts")]
    return Model(languages, [
        (doc_id, cells.values.to_numpy().astype(np.int32), counts.values.to_numpy(), number[lang])
        for doc_id, lang, cells, counts in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True)
    ])


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            rows = [own.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each text; only the text decides.

    A null text and one without a letter (empty, digits, marks) are ``und`` with score 0; so is
    every text if nothing could be learnt. Ties go to the first language by name. Repeated rows
    score alike; null ids are returned; an empty table gives no rows. Texts are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predicted(sent(docs.sparkSession, model)), "doc_id long, lang_pred string, score double")

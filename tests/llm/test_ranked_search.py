"""Ranked search against plain scores, and the graph of shared sets against plain sums."""

import math
import pickle
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from punctual.llm import ranked_search as search
from punctual.llm import store

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, top=50):
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    n, total = sum(1 for _, own in counted if own), sum(sum(own.values()) for _, own in counted)
    df = Counter(term for _, own in counted for term in own)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, own in asked.items():
        scored = []
        for doc, tf in counted:
            m = 50 + (50 * sum(tf.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found += [(item, rank, None if missing else doc, -score) for rank, (score, missing, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=str)


def found(spark, docs, items, top=50):
    result = search.best_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), top)
    return sorted(map(tuple, result.collect()), key=str)


def some(seed, docs, items, words=60):
    draw = random.Random(seed)
    names = [f"{'äÉ日x'[i % 4]}W{i}" for i in range(words)]
    text = lambda n: draw.choice([" ", ", ", "\n-"]).join(draw.choices(names, weights=[1 / (i + 1) for i in range(words)], k=n))
    return [(i, text(draw.randint(0, 90))) for i in range(docs)], [(i, text(draw.randint(1, 25))) for i in range(items)]


@pytest.mark.parametrize("top", [1, 7, 50])
def test_equals_plain_scores(spark, top):
    docs, items = some(1, 400, 30)
    assert found(spark, docs, items, top) == plain(docs, items, top)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 300)
    docs, items = some(2, 150, 25)
    assert found(spark, docs, items) == plain(docs, items)


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(9, "Same words"), (3, "same WORDS"), (3, "same words"), (None, "same words"), (None, None), (5, ""), (6, " .,; "), (7, None),
            (8, "other " * 400_000 + "same"), (10, "x" * 3_000_000 + " same"), (11, "ſame K words")]
    items = [(1, "same"), (2, "WORDS, words"), (None, "other"), (4, None), (5, "..."), (1, "words"), (6, "nowhere"), (1, "same")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_extra_columns(spark):
    docs, items = some(3, 40, 5)
    names = ("score", "rank", "n", "terms", "item_id", "tf")
    wide = spark.createDataFrame(docs, DOCS).withColumns({name: F.lit("x") for name in names})
    asked = spark.createDataFrame(items, ITEMS).withColumns({name: F.lit("x") for name in ("score", "doc_id", "term")})
    assert sorted(map(tuple, search.best_documents(wide, asked).collect()), key=str) == plain(docs, items)


@pytest.mark.parametrize("seed", range(20))
def test_shared_sums_add_up(seed):
    """Every item is the sum of its nodes, every node is worked out after its parts, and pairs are shared."""
    draw = random.Random(seed)
    sets = [draw.sample(range(40), draw.randint(0, 25)) for _ in range(30)]
    sums, whole = search._shared_plan([list(own) for own in sets])
    first = max((x for own in sets for x in own), default=-1) + 1
    content = {i: Counter([i]) for i in range(first)}
    for i, (a, b) in enumerate(sums):
        content[first + i] = content[a] + content[b]
    for own, nodes in zip(sets, whole):
        assert sum((content[x] for x in nodes), Counter()) == Counter(own)
    assert sum(map(len, whole)) + len(sums) < sum(map(len, sets))


def test_ranked_rows_go_to_few_files(spark, monkeypatch):
    docs, items = some(8, 300, 40)
    written = []
    monkeypatch.setattr(search, "stored", lambda frame, name: written.append((name, table := store.stored(frame, name))) or table)
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert found(spark, docs, items) == plain(docs, items)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [len(table.inputFiles()) <= 4 for name, table in written if name == "ranked"] == [True]


def test_no_array_of_a_task_is_larger_than_its_cells(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 500)
    own = search.Search([(i, b"t%d" % ((i * k) % 7)) for i in range(40) for k in (1, 2, 3)])
    own.weigh(60, 600, np.full(len(own.terms), 5))
    assert len(own.parts) > own.nodes
    sizes, scores = [], search.Search.scores
    monkeypatch.setattr(search.Search, "scores", lambda self, lengths, *rest: sizes.append(len(lengths)) or scores(self, lengths, *rest))
    terms, tf = np.array([0, 1, 2], np.int32).tobytes(), np.array([1, 2, 1], np.int32).tobytes()
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(60), pa.int64()), pa.array([10] * 60, pa.int64()), pa.array([terms] * 60, pa.binary()), pa.array([tf] * 60, pa.binary())],
        names=["doc_id", "n", "terms", "tf"],
    )
    best = [rows for rows in search._best(SimpleNamespace(value=pickle.dumps(own)), 5)(iter([batch]))]
    assert sum(sizes) == 60 and max(sizes) * max(own.nodes, len(own.parts)) <= 500
    # Equal scores: the first documents of each item.
    assert {row["doc_id"] for rows in best for row in rows.to_pylist()} == set(range(5))

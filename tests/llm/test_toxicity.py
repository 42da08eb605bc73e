"""The block-max index of toxicity against cosines worked out plainly over all terms of all examples."""

import math
import pickle
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from punctual.llm import toxicity

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def learnt(spark):
    """Two languages of 700 examples each, every seventh with a telling word; some are exact copies, one is empty."""
    random = np.random.default_rng(11)
    chances = 1 / np.arange(1, 201)
    rows = [(0, "")]
    for i in range(1, 1401):
        words = [f"{'abcdefghij'[n % 10] * 2}{'klmnopqrst'[n // 10 % 10]}{'uvwxyz'[n // 100]}{'no' if i % 2 else 'ja'}" for n in random.choice(200, random.integers(5, 60), p=chances / chances.sum())]
        if i % 7 == 0:
            words[:2] = ["grubling", "grubster"][: i % 2 + 1]
        rows.append((i, rows[-2][1] if i % 50 == 3 else " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, int("grub" in text)) for i, text in rows], "doc_id long, toxic int")
    return dict(rows), toxicity.trained(docs, marks, F.lit(True))


def plain_vectors(texts, model):
    known = toxicity._Known(model.terms)
    found = []
    for text in texts:
        own = {term: (1 + math.log(n)) * model.index.idf[term] for term, n in known.counts(text).items()}
        size = math.sqrt(sum(x * x for x in own.values()))
        found.append({term: x / size for term, x in own.items()})
    return found


def test_every_word_of_every_example_is_in_the_index(learnt):
    texts, model = learnt
    words = {word for text in texts.values() for word in text.split()}
    assert words <= set(model.terms)
    # Examples without a telling term are in it too.
    assert sorted(model.index.ids) == [i for i, text in sorted(texts.items()) if text]


def test_neighbours_equal_all_cosines_with_ties_to_the_lower_number(learnt):
    texts, model = learnt
    index, known = model.index, toxicity._Known(model.terms)
    examples = plain_vectors([texts[i] for i in index.ids], model)
    asked = [texts[i] for i in range(1, 1400, 23)] + ["grubling unheard", "aakuno", texts[53], texts[52]]
    counts = [known.counts(text) for text in asked]
    together, done = index.search(counts, [None] * len(asked))
    for vector, own, (numbers, cosines) in zip(plain_vectors(asked, model), counts, together, strict=True):
        every = [(-round(sum(x * other.get(term, 0) for term, x in vector.items()), 12), n) for n, other in enumerate(examples)]
        best = sorted(x for x in every if x[0] < 0)[: toxicity.NEIGHBOURS]
        assert cosines == pytest.approx([-x for x, _ in best], abs=1e-10)
        # Where sums differ by more than their last digits, the order is the same.
        if len({round(-x, 9) for x, _ in best}) == len(best):
            assert numbers.tolist() == [n for _, n in best]
        alone = index.nearest(own)
        assert alone[0].tolist() == numbers.tolist() and alone[1].tolist() == cosines.tolist()
    # Copies are equally near, the lower number first.
    copies = together[-2]
    assert copies[1][0] == copies[1][1] == 1 and copies[0][0] < copies[0][1]
    assert {int(index.ids[n]) for n in copies[0][:2]} == {51, 53}
    # Blocks that can hold no neighbour are not finished.
    assert index.blocks > 20 and done.mean() < 0.9


def test_an_example_has_no_vote_on_itself(learnt):
    texts, model = learnt
    counts = toxicity._Known(model.terms).counts(texts[100])
    numbers, _ = model.index.nearest(counts, 100)
    assert 100 in model.index.ids[model.index.nearest(counts)[0]] and 100 not in model.index.ids[numbers]


def test_odd_texts_and_the_evidence(spark, learnt):
    texts, model = learnt
    rows = [(1, "grubling aakuno"), (2, texts[8]), (3, None), (4, ""), (5, "unheard 123"), (None, "grubling aakuno"), (1, "grubling aakuno")]
    found = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and [by_id[i].predicted for i in (1, 2, 3, 4, 5, None)] == [1, 0, 0, 0, 0, 1]
    assert len({(r.score, tuple(r.evidence)) for r in found if r.doc_id in (1, None)}) == 1
    assert by_id[1].evidence and all("grub" in texts[i] for i in by_id[1].evidence)
    assert not by_id[3].evidence and not by_id[5].evidence and by_id[3].score == by_id[4].score == by_id[5].score


def test_terms_of_a_text_are_its_words_and_their_known_beginnings():
    words = {"grub", "grubling", "grubster", "word", "über", "überall"}
    marked = {"gru*", "grubl*", "grubs*", "übe*", "überal*", "wor*"}
    terms = {term: i for i, term in enumerate(sorted(words | marked))}
    known = toxicity._Known(terms)
    text = "Grubling word grubling überall grub über 123 überalle gru grubland wo unheard"
    plain = Counter(terms[term] for word in toxicity._WORDS(text.lower()) for term in toxicity.terms_of(word) if term in terms)
    assert known.counts("grub Grubling grubster ÜBER überall") and not known  # words of the index need no look at their letters
    assert known.counts(text) == plain
    assert known.counts(None) == known.counts("") == known.counts("unheard 123") == {}
    assert toxicity._Known({}).counts(text) == {}


def test_an_index_is_loaded_in_little_more_than_its_postings():
    size, held = 4000, 50
    index = toxicity.Index(
        np.ones(size), np.arange(size), np.zeros(size, np.int64), np.full(size, held),
        np.arange(size * held, dtype=np.int32) % size, np.arange(size * held, dtype=np.int32) % 7 + 1,
    )
    state = pickle.dumps(index)
    tracemalloc.start()
    loaded = pickle.loads(state)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * size * held
    assert np.array_equal(loaded.values, index.values) and np.array_equal(loaded.times, index.times)
    assert np.array_equal(loaded.values, (1 + np.log(index.times.astype(float))) / index.lengths[index.places])


def test_tasks_give_memory_back(learnt, monkeypatch):
    texts, model = learnt
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1))
    sent = SimpleNamespace(value=pickle.dumps(model))
    joined = SimpleNamespace(value=pickle.dumps(toxicity._joined(model.terms)))
    ids = pa.array(range(1, 9), pa.int64())
    rows = pa.array([texts[i] for i in range(1, 9)])
    labels = pa.array([0, 1] * 4, pa.int32())
    runs = [
        (toxicity._harmless(sent), [ids, rows], ["doc_id", "text"]),
        (toxicity._scored(sent), [ids, rows], ["doc_id", "text"]),
        (toxicity._votes(sent), [ids, rows, labels], ["doc_id", "text", "label"]),
        (toxicity._vectors(joined), [ids, rows, labels], ["doc_id", "text", "label"]),
        (toxicity._sampled_terms, [rows, labels, ids], ["text", "label", "doc_id"]),
    ]
    for done, (run, columns, names) in enumerate(runs, 1):
        assert sum(batch.num_rows for batch in run(iter([pa.RecordBatch.from_arrays(columns, names=names)])))
        assert len(given) == done

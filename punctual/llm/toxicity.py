"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The terms of a text are all its words, and those beginnings of words that tell the classes apart
in a bounded sample of labelled rows. Each example of the sample has a TF-IDF vector over all its
terms (a term's weight is greater, the more of the toxic examples hold it) and lies in a block-max
inverted index: examples are numbered by the length of their vectors and cut into blocks, and for
each common term the index knows its greatest weight in each block. A text's cosines are added up
over its rare terms first; then blocks are finished from the one that could hold the nearest
example downwards, until no block left can hold one as near as the k-th best, so the neighbours
are exact. Their votes weigh more the nearer they are; a monotone table, fitted on the votes of the
third of the examples that had no say in the terms and weights, turns them into probabilities.
"""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.store import dropped, give_back, sent, stored

#: Labelled rows that train at most, picked by a hash of the id; more rows change no other bound.
SAMPLE = 12_000
#: Beginnings kept (words all are); how many times likelier the toxic class must make one; and the
#: evidence that takes, as its toxic examples times the log of that (8 is some three examples and no other).
TERMS, LIFT, EVIDENCE = 4096, 4.0, 8.0
#: Lengths of the word beginnings that may be terms.
STEMS = (3, 4, 5, 6, 7, 8)
#: Neighbours that vote, examples of a block, and blocks that are finished in the rounds before the last.
NEIGHBOURS, BLOCK, ROUNDS = 15, 64, (4, 16)
#: A term is common if more than one example in so many holds it, and so many terms are at most. Texts compared at once.
COMMON, DENSE, TOGETHER = 16, 1024, 256
#: From this score on a text counts as toxic.
THRESHOLD = 0.3
#: Words whose beginnings a task remembers, and postings that are weighed at once.
REMEMBERED, WEIGHED = 300_000, 1 << 15

_WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: examples with the term, and by class those of them that have a say in the weights."""
    found: dict[str, list[int]] = {}

    def counted() -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in found.values()], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), columns[2], columns[0], columns[1]], names=["term", "examples", "clean", "toxic"])

    for batch in batches:
        for text, label, doc_id in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            tells = not calibrates(doc_id)
            for term in {term for word in set(_WORDS((text or "").lower())) for term in terms_of(word)}:
                own = found.setdefault(term, [0, 0, 0])
                own[2] += 1
                if tells:
                    own[label] += 1
            if len(found) > 1_000_000:
                yield counted()
                found.clear()
    yield counted()
    found.clear()
    give_back()


def _vectors(shared):
    """Per example: its terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(_parted(pickle.loads(shared.value)))
        for batch in batches:
            rows = [known.counts(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(x) for x in rows], pa.list_(pa.int32())),
                 pa.array([list(x.values()) for x in rows], pa.list_(pa.int32()))],
                names=["doc_id", "label", "terms", "counts"],
            )
        del known
        give_back()

    return run


def _joined(terms: dict[str, int]) -> bytes:
    """The terms, numbered in order, in few bytes."""
    return zlib.compress("\n".join(terms).encode(), 1)


def _parted(joined: bytes) -> dict[str, int]:
    text = zlib.decompress(joined).decode()
    return {term: i for i, term in enumerate(text.split("\n"))} if text else {}


class _Known(dict):
    """Known beginnings of each word, and the known terms of a text."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms
        self.starts = {term[:-1]: i for term, i in terms.items() if term.endswith("*")}
        #: The first five letters of the longer of them tell most other words apart.
        self.heads = {term[:5] for term in self.starts}
        #: Of each term the known beginnings of the word (0: none; else the place of a tuple in ``alike``).
        self.begun, alike, words = array("H", bytes(2 * len(terms))), {(): 0}, list(terms)
        # The terms are sorted, so words of one beginning follow each other; no more sets of beginnings than beginnings.
        self.alike = [()]
        for start, i in sorted(self.starts.items()):
            for at in range(bisect_left(words, start), bisect_left(words, start + chr(sys.maxunicode))):
                own = (*self.alike[self.begun[at]], i)
                if own not in alike:
                    alike[own] = len(alike)
                    self.alike.append(own)
                self.begun[at] = alike[own]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.starts[word[:n]] for n in STEMS if len(word) >= n and word[:n] in self.starts)
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        words = Counter(_WORDS((text or "").lower()))
        numbers = list(map(self.terms.get, words))
        found = dict(zip(numbers, words.values(), strict=True))
        unknown = found.pop(None, 0)
        begun, alike, starts, heads = self.begun, self.alike, self.starts, self.heads
        for own in [own for own in found if begun[own]]:
            times = found[own]
            for term in alike[begun[own]]:
                found[term] = found.get(term, 0) + times
        if unknown:
            for word, own in zip(words, numbers, strict=True):
                if own is None and (word[:5] in heads or word[:4] in starts or word[:3] in starts):
                    for term in self[word]:
                        found[term] = found.get(term, 0) + words[word]
        return found


def _compact(numbers: np.ndarray) -> np.ndarray:
    """The numbers, none below 0, in the fewest bytes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, one run after the other, and the runs' sizes."""
    sizes = ends - starts
    after = np.cumsum(sizes)
    places = np.arange(after[-1] if len(after) else 0)
    places += np.repeat(starts - after + sizes, sizes)
    return places, sizes


class Index:
    """Block-max inverted index over the examples that have a term.

    ``sizes`` are the numbers of terms of each example, ``terms`` and ``counts`` those of one
    example after the other.
    """

    def __init__(self, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.idf = idf
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        weights = (1 + np.log(counts)) * idf[terms]
        lengths = np.sqrt(np.bincount(owner, weights * weights, len(ids)))
        held = np.bincount(terms, minlength=len(idf))
        common = np.argsort(-held, kind="stable")[:DENSE]
        common = np.sort(common[held[common] > len(ids) / COMMON])
        # Examples that share their heaviest common term share blocks, and so do those of like length: that tightens the blocks' bounds.
        dense = np.flatnonzero(np.isin(terms, common))
        dense = dense[np.lexsort((terms[dense], weights[dense], owner[dense]))]
        heaviest = np.zeros(len(ids), np.int64)
        heaviest[owner[dense]] = terms[dense]
        del weights, dense
        order = np.lexsort((ids, lengths, heaviest))
        order = order[lengths[order] > 0]
        number = np.full(len(ids), -1, np.int32)
        number[order] = np.arange(len(order))
        self.ids, self.labels, self.lengths = ids[order], labels[order].astype(np.float64), lengths[order]
        self.common = common
        # Postings term by term, each term's by example.
        place = number[owner]
        order = np.lexsort((place, terms))
        self.places, self.times = place[order], _compact(counts[order])
        self.starts = np.concatenate([[0], np.cumsum(held)])
        self._weigh()

    def _weigh(self) -> None:
        """What follows from the postings."""
        self.values = np.empty(len(self.places))
        held = np.diff(self.starts)
        # Terms of some postings at a time, so that little else is in memory.
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.places), WEIGHED)).tolist()
        for first, last in pairwise([*cuts, len(held)]):
            own = slice(self.starts[first], self.starts[last])
            weights = (1 + np.log(self.times[own].astype(np.float64))) * np.repeat(self.idf[first:last], held[first:last])
            self.values[own] = weights / self.lengths[self.places[own]]
        self.row = np.full(len(self.idf), -1, np.int32)
        self.row[self.common] = np.arange(len(self.common))
        self.blocks = -(-len(self.ids) // BLOCK)

    def __getstate__(self) -> bytes:
        """The postings alone, in few bytes, as every machine gets them; the rest is worked out again."""
        few = [_compact(x) for x in (self.places, self.times, np.diff(self.starts))]
        return zlib.compress(pickle.dumps((self.idf, self.ids, self.labels, self.lengths, self.common, *few), protocol=5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.idf, self.ids, self.labels, self.lengths, self.common, places, times, held = pickle.loads(zlib.decompress(state))
        self.places, self.times = places.astype(np.int32), times
        self.starts = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        self._weigh()

    @cached_property
    def dense(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block the common terms that it holds, and their weights in its examples."""
        at, sizes = _runs(self.starts[self.common], self.starts[self.common + 1])
        places, row = self.places[at], np.repeat(np.arange(len(self.common), dtype=np.int32), sizes)
        order = np.argsort(places, kind="stable")
        at, places, row = at[order], places[order], row[order]
        ends = np.searchsorted(places, np.arange(self.blocks + 1) * BLOCK)
        found = []
        for block in range(self.blocks):
            own = slice(ends[block], ends[block + 1])
            held = np.flatnonzero(np.bincount(row[own], minlength=len(self.common)))
            weights = np.zeros((len(held), BLOCK))
            weights[np.searchsorted(held, row[own]), places[own] - block * BLOCK] = self.values[at[own]]
            found.append((held, weights))
        return found

    @cached_property
    def most(self) -> np.ndarray:
        """Greatest weight of each common term in each block."""
        found = np.zeros((len(self.common), self.blocks))
        for block, (held, weights) in enumerate(self.dense):
            found[held, block] = weights.max(axis=1, initial=0)
        return found

    def weighted(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(terms)
        terms = terms[order]
        weights = (1 + np.log(times[order])) * self.idf[terms]
        size = np.sqrt((weights * weights).sum())
        return terms, weights / size if size > 0 else weights

    def nearest(self, counts: dict[int, int], without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the nearest, ties to the lower number; examples of the id ``without`` are left out."""
        return self.search([counts], [without])[0][0]

    def search(self, texts: list[dict[int, int]], without: list[int | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of each text the numbers and cosines (to 12 digits) of its nearest, and the blocks that were finished for it."""
        scores = np.zeros((len(texts), self.blocks * BLOCK))
        common = np.zeros((len(texts), len(self.common)))
        for own, into, (counts, left) in zip(scores, common, zip(texts, without, strict=True), strict=True):
            terms, weights = self.weighted(counts)
            rows = self.row[terms]
            into[rows[rows >= 0]] = weights[rows >= 0]
            terms, weights = terms[rows < 0], weights[rows < 0]
            if len(terms):
                at, sizes = _runs(self.starts[terms], self.starts[terms + 1])
                own += np.bincount(self.places[at], self.values[at] * np.repeat(weights, sizes), len(own))
            if left is not None:
                own[np.flatnonzero(self.ids == left)] = -np.inf
        by_block = scores.reshape(len(texts), self.blocks, BLOCK)
        # No example of a block can be nearer than its best sum so far and the block's greatest weights together.
        bounds = common @ self.most + by_block.max(axis=2, initial=-np.inf)
        least, done = np.zeros(len(texts)), np.zeros(bounds.shape, bool)
        for blocks in (*ROUNDS, self.blocks):
            wanted = ~done & (bounds > 0) & (bounds >= least[:, None] - 1e-9)
            if blocks < self.blocks:
                best = np.argpartition(np.where(wanted, -bounds, np.inf), blocks, axis=1)[:, :blocks]
                first = np.zeros_like(wanted)
                np.put_along_axis(first, best, True, axis=1)
                wanted &= first
            for block in np.flatnonzero(wanted.any(axis=0)):
                own = np.flatnonzero(wanted[:, block])
                held, weights = self.dense[block]
                by_block[own, block] += common.take(own, axis=0).take(held, axis=1) @ weights
            done |= wanted
            if blocks < self.blocks:
                for text, own in enumerate(wanted):
                    values = by_block[text, own].ravel()
                    if len(values) > NEIGHBOURS:
                        least[text] = max(least[text], np.partition(values, len(values) - NEIGHBOURS)[len(values) - NEIGHBOURS])
        found = []
        for text, own in enumerate(done):
            numbers = np.flatnonzero(own)
            values = by_block[text, numbers]
            block, place = np.nonzero((values > 0) & (values >= least[text] - 1e-9))
            # The sums' last digits depend on how many texts are compared at once.
            numbers, values = numbers[block] * BLOCK + place, values[block, place].round(12)
            best = np.lexsort((numbers, -values))[:NEIGHBOURS]
            found.append((numbers[best], values[best]))
        return found, done

    def vote(self, numbers: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Share of toxic among the neighbours by the inverse of their distance, drawn to the prior by one weak vote."""
        weights = 1 / (1.05 - np.minimum(cosines, 1))
        return float((weights @ self.labels[numbers] + 0.5 * prior) / (weights.sum() + 0.5))


def monotone(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising table of mean labels by score (pool adjacent violators)."""
    points, place = np.unique(scores, return_inverse=True)
    totals = np.bincount(place)
    pools: list[list[float]] = []
    for at, total, hits in zip(points, totals, np.bincount(place, labels), strict=True):
        pools.append([at, at, total, hits])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, last, total, hits = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = last, pools[-1][2] + total, pools[-1][3] + hits
    table = [(at, (hits + 0.5) / (total + 1)) for first, last, total, hits in pools for at in dict.fromkeys((first, last))]
    return np.array([x for x, _ in table]), np.maximum.accumulate([y for _, y in table])


def calibrates(doc_id: int) -> bool:
    """Examples that fit the calibration and have no say in the terms: one in three."""
    return xxhash.xxh64_intdigest(str(doc_id)) % 3 == 0


class Model:
    """Terms, the index, the calibration and the score of a text without known terms."""

    def __init__(self, terms: dict[str, int], index: Index, plain: float):
        self.terms, self.index, self.plain = terms, index, plain
        self.prior = float(index.labels.mean()) if len(index.labels) else 0.0
        self.points, self.values = np.array([0.0]), np.array([plain])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"terms": _joined(self.terms)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, terms=_parted(state["terms"]))

    def calibrated(self, votes: np.ndarray, labels: np.ndarray) -> Model:
        if len(votes):
            self.points, self.values = monotone(votes, labels)
        return self

    def scores(self, texts: list[dict[int, int]]) -> list[tuple[float, list[int]]]:
        """Probability of the toxic label, and the ids of the neighbours that speak for what it says."""
        return [self._said(*near) for near in self.index.search(texts, [None] * len(texts))[0]]

    def _said(self, numbers: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int]]:
        if not len(numbers):
            return self.plain, []
        vote = self.index.vote(numbers, cosines, self.prior)
        score = float(np.interp(vote, self.points, self.values))
        return score, self.index.ids[numbers[(self.index.labels[numbers] > 0) == (score >= THRESHOLD)]].tolist()


def _together(model: Model, known: _Known, texts: pa.Array) -> list[tuple[float, list[int]]]:
    """Scores of texts, a few read and compared at once."""
    parts = (texts.slice(i, TOGETHER).to_pylist() for i in range(0, len(texts), TOGETHER))
    return [x for part in parts for x in model.scores([known.counts(text) for text in part])]


def _votes(model):
    """Of each calibrating example: the vote of its neighbours, itself left out, and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        known = _Known(own.terms)
        for batch in batches:
            rows = [row for row in zip(*(column.to_pylist() for column in batch.columns), strict=True) if calibrates(row[0])]
            found = []
            for i in range(0, len(rows), TOGETHER):
                some = [(known.counts(text), doc_id, float(label)) for doc_id, text, label in rows[i : i + TOGETHER]]
                some = [x for x in some if x[0]]
                near, _ = own.index.search([x[0] for x in some], [x[1] for x in some])
                found += [(own.index.vote(*x, own.prior), label) for x, (_, _, label) in zip(near, some, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())], names=["vote", "label"])
        del own, known
        give_back()

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        known = _Known(own.terms)
        for batch in batches:
            rows = _together(own, known, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in rows], pa.float64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "score", "evidence"],
            )
        del own, known
        give_back()

    return run


def trained(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Model learnt from the rows of ``labels`` that ``usable`` (over doc_id) admits.

    At most about ``sample`` labelled rows train, picked by a hash of the id; null labels and
    ids are left out. The driver holds the sample's terms and vectors, not texts.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(max(1, total))) < sample)
    examples = stored(docs.select(F.col("doc_id").cast("long"), "text").join(picked, "doc_id").select("doc_id", "text", "label"), "examples")
    counts = (
        examples.select("text", "label", "doc_id").mapInArrow(_sampled_terms, "term string, examples long, clean long, toxic long")
        .groupBy("term").agg(*[F.sum(name).alias(name) for name in ("examples", "clean", "toxic")])
    )
    counts = stored(counts, "terms")
    sizes = picked.groupBy("label").count().collect()
    size = {row["label"]: row["count"] for row in sizes}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    told = counts.where(F.col("term").endswith("*")).withColumn(
        "lift", ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    ).where((F.col("lift") >= LIFT) & (F.col("toxic") * F.log("lift") >= EVIDENCE))
    # The beginnings whose counts are least likely by chance: toxic share times the log of the lift.
    best = told.orderBy(F.desc(F.col("toxic") * F.log("lift")), "term").limit(TERMS).drop("lift")
    chosen = counts.where(~F.col("term").endswith("*")).unionByName(best).orderBy("term").toArrow()
    dropped(counts)
    terms = {term: i for i, term in enumerate(chosen["term"].to_pylist())}
    often, clean, toxic = (chosen[name].to_numpy().astype(np.float64) for name in ("examples", "clean", "toxic"))
    shared = sent(spark, _joined(terms))
    found = examples.mapInArrow(_vectors(shared), "doc_id long, label int, terms array<int>, counts array<int>").toArrow()
    shared.destroy()
    # Inverse frequency, times the relevance: toxic examples to one clean one, on a scale of logs.
    idf = (1 + np.log((found.num_rows + 1) / (often + 1))) * np.log2(2 + toxic / np.maximum(1, clean))
    ids, label = found["doc_id"].to_numpy(), found["label"].to_numpy()
    lengths = pc.list_value_length(found["terms"]).to_numpy()
    index = Index(idf, ids, label, lengths, *(pc.list_flatten(found[name]).to_numpy() for name in ("terms", "counts")))
    without = label[(lengths == 0) & np.array([calibrates(int(i)) for i in ids], bool)]
    model = Model(terms, index, float((without.sum() + 0.01) / (len(without) + 1)))
    shared = sent(spark, model)
    votes = examples.mapInArrow(_votes(shared), "vote double, label double").toArrow()
    shared.destroy()
    dropped(examples)
    return model.calibrated(votes["vote"].to_numpy(), votes["label"].to_numpy())


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id if not given) with ``score``, ``predicted`` and ``evidence``.

    Only the text decides; ``evidence`` are the ids of those neighbours that are labelled as predicted.
    A text without known terms, a null or an empty one gets the score of such examples and no evidence.
    Of examples at the same cosine, those count that the index holds first. Repeated rows score alike;
    null ids are returned; an empty table gives no rows. Without labels every score is that of no
    evidence, near 0.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{name}`") for name in keep], F.col("text").alias("_scored_text"))
    types = [f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1]]
    shared = sent(docs.sparkSession, model)  # bounded by SAMPLE and the terms of its texts
    found = rows.mapInArrow(_scored(shared), ", ".join([*types, "score double", "evidence array<long>"]))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _harmless(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        known = _Known(own.terms)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score < THRESHOLD for score, _ in _together(own, known, texts)], pa.bool_()))
        del own, known
        give_back()

    return run


def harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    return docs.mapInArrow(_harmless(sent(docs.sparkSession, model)), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2

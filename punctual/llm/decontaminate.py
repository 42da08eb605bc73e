"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct shingles. A partition's sketch is as many
of each item's least shingle hashes as an item of that size may miss, and one more: a document
that contains the asked share of an item then holds at least one of them, so the search loses
nothing however long the document is. What it finds is verified on all the item's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.shingles import WordCodes, shingle_codes, words_of
from punctual.llm.store import give_back, sent, stored

#: Share of an item's distinct shingles that a document must hold, in hundredths.
SHARE = 75
#: Shingles of items that are searched for in one pass over the documents (8 bytes each).
PASS = 1 << 21


class Sketches:
    """Items of one pass: their sketches by size partition, and their whole sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], share: int):
        self.ids = [item for item, _ in items]
        self.sets = [codes for _, codes in items]
        self.needed = [-(-share * len(codes) // 100) for codes in self.sets]
        least: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        # Partition by size: all items of a size have sketches of the same length.
        for size in sorted({len(codes) for codes in self.sets}):
            length = size - -(-share * size // 100) + 1
            for i, codes in enumerate(self.sets):
                if len(codes) == size:
                    least.append(codes[:length])
                    owners.append(np.full(length, i))
        hashes, owner = np.concatenate(least), np.concatenate(owners)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        # One bit a hash says quickly that most shingles of a document are in no sketch.
        self.bits = max(16, int(np.ceil(np.log2(64 * len(hashes)))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def found(self, codes: np.ndarray) -> list[tuple[int, float]]:
        """Items of which the document (its shingles, in any order) holds enough, with the share."""
        likely = codes[self.seen[(codes >> np.uint64(64 - self.bits)).astype(np.int64)]]
        if not len(likely):
            return []
        likely = np.unique(likely)
        starts, ends = np.searchsorted(self.hashes, likely), np.searchsorted(self.hashes, likely, "right")
        candidates = sorted({int(i) for start, end in zip(starts, ends, strict=True) for i in self.owner[start:end]})
        if not candidates:
            return []
        own, rows = np.unique(codes), []
        for i in candidates:
            asked = self.sets[i]
            held = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked))
            if held >= self.needed[i]:
                rows.append((self.ids[i], held / len(asked)))
        return rows


def _searched(sketches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        known, own = WordCodes(), pickle.loads(sketches.value)
        for batch in batches:
            found = [own.found(shingle_codes(words_of(text), known)) for text in batch.column(1).to_pylist()]
            rows = np.flatnonzero([len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([[i for i, _ in found[row]] for row in rows], pa.list_(pa.int64())),
                 pa.array([[x for _, x in found[row]] for row in rows], pa.list_(pa.float64()))],
                names=["doc_id", "items", "shares"],
            )

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each item that has any."""
    known = WordCodes()
    for batch in batches:
        sets = [np.unique(shingle_codes(words_of(text), known)) for text in batch.column(1).to_pylist()]
        rows = np.flatnonzero([len(x) for x in sets])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array([len(sets[row]) for row in rows], pa.int64()),
             pa.array([sets[row].tobytes() for row in rows], pa.binary())],
            names=["item_id", "size", "codes"],
        )


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of ``PASS`` shingles or a little more; the driver holds one block at a time.

    Tasks make the shingles and deal the items into blocks; the driver only collects a block's codes.
    """
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    coded = stored(rows.mapInArrow(_coded, "item_id long, size long, codes binary"), "items")
    blocks = max(1, -(-(coded.agg(F.sum("size")).first()[0] or 0) // PASS))
    for block in range(blocks):
        found = coded.where(F.pmod(F.xxhash64("item_id", "codes"), F.lit(blocks)) == block).select("item_id", "codes").toArrow()
        if found.num_rows:
            yield [(item, np.frombuffer(codes, np.uint64)) for item, codes in zip(*(x.to_pylist() for x in found.columns), strict=True)]


def contained_items(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment`` of each pair with enough of the item in the document.

    Shingles are distinct runs of five words, with A-Z lower-cased; a text of fewer words is one
    shingle of all of them, which only another text of just these words holds. Containment is
    the share of the item's shingles that the whole document holds; ``share`` hundredths or more
    make a row. Null, empty or blank texts hold nothing and are in nothing; items without an id
    are left out; a null doc_id is returned as such. Repeated rows of either table give a row for
    each. Empty tables give no rows. Columns besides id and text are not read. The documents are
    read once for every ``PASS`` shingles of the benchmark, which alone decides the driver's memory;
    one block and its broadcast is alive at a time.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for block in _passes(benchmark):
        shared = sent(spark, Sketches(block, share))
        rows = stored(source.mapInArrow(_searched(shared), "doc_id long, items array<long>, shares array<double>"), "contained")
        shared.destroy()
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, containment double")
    pairs = found.select("doc_id", F.explode(F.arrays_zip("items", "shares")).alias("pair"))
    return pairs.select("doc_id", F.col("pair.items").alias("item_id"), F.col("pair.shares").alias("containment"))


def _clean(sketches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        give_back()
        known, own = WordCodes(), pickle.loads(sketches.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not own.found(shingle_codes(words_of(text), known)) for text in texts], pa.bool_()))
        del known, own
        give_back()

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns.

    Every row is judged by its own text, whatever its id; one pass over the rows follows the other.
    """
    for block in _passes(benchmark):
        docs = docs.mapInArrow(_clean(sent(docs.sparkSession, Sketches(block, share))), docs.schema)
    return docs

"""Ranked lexical search for many queries at once, with partial scores shared between them.

1. ``_shared_plan`` mines the term sets that items have in common. Terms held by just the same items
   form one set; pairs of sets that follow each other in several items, most frequent set first, are
   joined into a larger set, again and again, until no pair is in two items. The result is a graph in
   which every set is the sum of two others, and every item the sum of a few sets.
2. ``_frequencies`` reads every text once and writes, for each document, its length and the
   frequencies of terms that any item asks for. Corpus counts come from that table.
3. ``_best`` works out each set's partial score once per document, along the graph from small sets to
   large ones, sums the items from them and keeps a task's best rows of each item; the best of all
   tasks are ranked in two steps.

Items go in blocks of about ``BLOCK`` characters; only one block's terms and graph are on the driver and in
broadcasts at a time, and each block is searched in all documents.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.store import give_back, sent, stored

#: Characters of items that are searched for in one pass over the documents.
BLOCK = 1 << 23
#: Cells of the largest array (sets, or sets of all items, by documents) that a task works on.
CELLS = 1 << 22
#: Bytes of a text that are parted into words at a time.
PIECE = 1 << 20
#: Parts in which an item's rows are ranked before they meet.
SALTS = 32
#: Files that a block's ranked rows are written to at least, and rows of a file at most.
FILES, ROWS = 4, 1 << 18

#: Lower-cases A-Z and blanks whatever is in no term; bytes of other scripts stay.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, some of them at a time."""
    folded = text.translate(_FOLDED) if text else b""
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _incidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for words in terms_of(text):
                own = list(set(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"]
                )


def _shared_plan(sets: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Sums of two nodes, in the order they can be worked out, and the nodes that each item adds up.

    ``sets`` holds the nodes of each item without repeats; new nodes are numbered from the largest
    one on. A pair joined in a round is in two items or more.
    """
    often = Counter(node for own in sets for node in own)
    sets = [sorted(own, key=lambda node: (-often[node], node)) for own in sets]
    fresh = max((node for own in sets for node in own), default=-1) + 1
    sums: list[tuple[int, int]] = []
    while True:
        pairs = Counter(pair for own in sets for pair in zip(own, own[1:]))
        if not pairs or max(pairs.values()) < 2:
            return sums, sets
        joined: dict[tuple[int, int], int] = {}
        for i, own in enumerate(sets):
            after, at = [], 0
            while at < len(own):
                pair = tuple(own[at : at + 2])
                # Of two pairs that overlap, the more frequent one is joined.
                if pairs[pair] >= 2 and pairs[pair] >= pairs[tuple(own[at + 1 : at + 3])]:
                    if pair not in joined:
                        joined[pair] = fresh + len(sums)
                        sums.append(pair)
                    after.append(joined[pair])
                    at += 2
                else:
                    after.append(own[at])
                    at += 1
            sets[i] = after


class Search:
    """The items of one block: their terms, the graph of shared sets, and the corpus counts."""

    def __init__(self, incidences: list[tuple[int | None, bytes]]):
        holders: dict[bytes, list] = defaultdict(list)
        for item, term in incidences:
            holders[term].append(item)
        self.items = sorted({item for item, _ in incidences}, key=lambda item: (item is None, item))
        numbers = {item: i for i, item in enumerate(self.items)}
        self.terms = {term: i for i, term in enumerate(sorted(holders))}
        atoms: dict[tuple[int, ...], int] = {}
        self.node = np.array(
            [atoms.setdefault(tuple(sorted(numbers[item] for item in holders[term])), len(atoms)) for term in self.terms], np.int64
        )
        sets: list[list[int]] = [[] for _ in self.items]
        for own, atom in atoms.items():
            for item in own:
                sets[item].append(atom)
        sums, sets = _shared_plan(sets)
        self.nodes = len(atoms) + len(sums)
        depth = np.zeros(self.nodes, np.int64)
        for i, (a, b) in enumerate(sums):
            depth[len(atoms) + i] = 1 + max(depth[a], depth[b])
        #: Sums by level: (node, one part, other part) arrays.
        table = np.array([(len(atoms) + i, a, b) for i, (a, b) in enumerate(sums)], np.int64).reshape(-1, 3)
        self.levels = [table[depth[table[:, 0]] == level].T for level in range(1, int(depth.max(initial=0)) + 1)]
        self.parts = np.array([node for own in sets for node in own], np.int64)
        self.starts = np.cumsum([0, *map(len, sets)])[:-1]

    def weigh(self, documents: int, length: int, df: np.ndarray) -> None:
        self.documents, self.length = documents, max(1, length)
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)

    def scores(self, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Score of each item (rows) in each document (columns)."""
        m = 50 + (50 * lengths * self.documents) // self.length
        partial = np.zeros((self.nodes, len(lengths)), np.int64)
        np.add.at(partial, (self.node[terms], row), self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row])))
        for node, a, b in self.levels:
            partial[node] = partial[a] + partial[b]
        return np.add.reduceat(partial[self.parts], self.starts, axis=0)


def _frequencies(found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pickle.loads(found.value).terms.get
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                length, own = 0, Counter()
                for words in terms_of(text):
                    length += len(words)
                    own.update(map(number, words))
                own.pop(None, None)
                lengths.append(length)
                terms.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                tfs.append(np.fromiter(own.values(), np.int32, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                names=["doc_id", "n", "terms", "tf"],
            )
        give_back()

    return run


def _holding(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])
        give_back()

    return run


def _best(found, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = pickle.loads(found.value)
        step = max(1, CELLS // max(1, search.nodes, len(search.parts)))
        least = np.zeros(len(search.items), np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def trimmed() -> None:
            """Keeps the best rows of each item; what an item holds ``top`` of sets its least score."""
            item, score, missing, doc = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((doc, missing, -score, item))
            item = item[order]
            keep = np.arange(len(item)) - np.searchsorted(item, item) < top
            item, order = item[keep], order[keep]
            held[:] = [(item, score[order], missing[order], doc[order])]
            score = held[0][1]
            full = np.flatnonzero(np.bincount(item, minlength=len(least)) >= top)
            least[full] = score[np.searchsorted(item, full, side="right") - 1]

        for batch in batches:
            missing = np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False), np.int8)
            docs = batch.column(0).fill_null(0).to_numpy()
            lengths = batch.column(1).to_numpy()
            terms, tfs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at in range(0, len(docs), step):
                own = [np.frombuffer(x, np.int32) for x in terms[at : at + step]]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                tf = np.frombuffer(b"".join(tfs[at : at + step]), np.int32).astype(np.int64)
                scores = search.scores(lengths[at : at + step], np.concatenate(own), tf, row)
                item, column = np.nonzero((scores >= least[:, None]) & (scores > 0))
                held.append((item, scores[item, column], missing[at + column], docs[at + column]))
                if sum(len(x[0]) for x in held) > 4 * top * len(least) + CELLS // 8:
                    trimmed()
        if held:
            trimmed()
            item, score, missing, doc = held[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([search.items[i] for i in item], pa.int64()), pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score)],
                names=["item_id", "doc_id", "score"],
            )
        held.clear()
        give_back()

    return run


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, first by parts of the documents."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return whole.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the ``top`` best documents of each item.

    Terms are runs of letters and digits of ASCII and of all other characters beyond it, A-Z
    lower-cased. Scores are sums of whole numbers over an item's distinct terms (see
    ``Search.scores``); only those above 0 are ranked, equal ones by doc_id, a null doc_id last.
    Texts that are null, empty or without terms match nothing and count in no statistic. Rows of the
    documents that repeat are ranked each. Rows of the items with one item_id are one item with all
    their terms; a null item_id is an item too. No documents or no items give no rows. Columns other
    than doc_id, item_id and text are not read. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK))
    found = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        pairs = own.mapInArrow(_incidences, "item_id long, term binary").distinct().toArrow()
        if not pairs.num_rows:
            continue
        search = Search(list(zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True)))
        vectors = stored(texts.mapInArrow(_frequencies(sent(spark, search)), "doc_id long, n long, terms binary, tf binary"), "vectors")
        count, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(search.terms), np.int64)
        counted = vectors.select("terms").mapInArrow(_holding(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        rows = counted.toArrow()
        df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
        search.weigh(count, length, df)
        best = vectors.mapInArrow(_best(sent(spark, search), top), "item_id long, doc_id long, score long")
        # Few rows go to few files, however many partitions rank them: Hadoop's local files cost processes.
        files = max(FILES, math.ceil(len(search.items) * top / ROWS))
        found.append(stored(_ranked(best, top).repartition(files), "ranked"))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found, empty)

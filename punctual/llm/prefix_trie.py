"""Trie of the turn prefixes that conversations share.

1. ``_segments``: turns are sorted by range, so a conversation of any length is spread over tasks; each
   task packs its turns, as two 64-bit codes and a length each, into rows of at most ``SEGMENT`` turns.
2. ``rebuilt``: the first turns of the base conversation are put before a conversation's own, and every
   prefix gets a 128-bit digest: the exclusive or of its turns' codes, each mixed with its depth.
   As that sum may be taken in any order, segments are digested on their own and then put together.
3. ``_sketch``: a count-min sketch of all prefix digests, with counters that stop at two. An estimate of
   one proves that a prefix belongs to one conversation alone; it and all longer ones are emitted
   where they are. Only prefixes that may be shared are shuffled and grouped by their whole digest.
4. ``prefix_trie``: groups are nodes. A node's subtree is summed along its members: what a node brings
   in is charged to its smallest member, summed from the deep end of each conversation, and added
   up over members.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.store import sent, stored

#: Turns of a conversation that one row holds.
SEGMENT = 4096
#: Cells of a row of the sketch for each prefix, and cells it has at least and at most. At two bits of
#: broadcast for a cell and its twin in the other row, the sketch is never over 64 MB; beyond some 100
#: million prefixes it proves fewer of them alone, and the rest is grouped exactly as ever.
SPARSE, LEAST, MOST = 8, 1 << 16, 1 << 28
#: Cells that are merged in one group, and prefixes that a task counts before it hands on its cells.
CELLS, HELD = 1 << 16, 1 << 21
#: Bytes of joined conversation numbers that one row holds.
PIECE = 1 << 16

_KEY = ["depth", "x1", "x2"]
_PATHS = "conv_id long, begins boolean, first long, turns long, x1 array<long>, x2 array<long>, chars array<long>"
_SCREENED = (
    "conv_id long, depth long, alone boolean, ends boolean, x1 long, x2 long, p1 long, p2 long, chars long, tail int"
)


def _mixed(codes: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Codes of turns at their depths; one to one for each depth."""
    with np.errstate(over="ignore"):
        z = codes + depths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of whole numbers."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(column) else []


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    values = np.concatenate(lists).astype(np.int64, copy=False) if lists else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of one sorted partition, packed by conversation."""
    place, part, conv = 0, 0, None
    held: list[list[np.ndarray]] = []
    size = 0
    done: list[tuple] = []

    def close() -> None:
        nonlocal place, held, size
        if size:
            done.append((conv, part, place, size, *(np.concatenate(column) for column in zip(*held, strict=True))))
            place += 1
        held, size = [], 0

    def batch_of() -> pa.RecordBatch:
        conv, part, place, size, *lists = zip(*done, strict=True)
        done.clear()
        arrays = [pa.array(conv, pa.int64()), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (place, size))]
        return pa.RecordBatch.from_arrays(
            [*arrays, *(_list_array(list(x)) for x in lists)], names=["conv_id", "part", "place", "size", "u1", "u2", "chars"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        convs, *columns = (batch.column(name).to_numpy() for name in ("conv_id", "u1", "u2", "chars"))
        part = batch.column("part")[0].as_py()
        cuts = np.flatnonzero(convs[1:] != convs[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(convs)], strict=True):
            if convs[start] != conv:
                close()
                conv = int(convs[start])
            while start < end:
                upto = min(end, start + SEGMENT - size)
                held.append([column[start:upto] for column in columns])
                size += upto - start
                start = upto
                if size == SEGMENT:
                    close()
        if len(done) >= 4096:
            yield batch_of()
    close()
    if done:
        yield batch_of()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix digests of each segment after the base's turns are put in; digests begin anew with each segment."""
    for batch in batches:
        convs, starts, own, heads = (batch.column(name).to_pylist() for name in ("conv_id", "start", "own", "h"))
        u1, u2, chars, b1, b2, b_chars = (_lists(batch.column(name)) for name in ("u1", "u2", "chars", "b1", "b2", "b_chars"))
        rows = []
        for i, (conv, start, total, h) in enumerate(zip(convs, starts, own, heads, strict=True)):
            b = min(h, len(b1[i]))
            skip = max(0, h - start)
            first = b + start + skip - h + 1
            parts = [x[i][skip:] for x in (u1, u2, chars)]
            if start == 0:
                first = 1
                parts = [np.concatenate([head[i][:b], part]) for head, part in zip((b1, b2, b_chars), parts, strict=True)]
            elif not len(parts[0]):
                continue
            depths = np.arange(first, first + len(parts[0]))
            digests = [np.bitwise_xor.accumulate(_mixed(x.view(np.uint64), depths)).view(np.int64) for x in parts[:2]]
            rows.append((conv, start == 0, first, b + max(0, total - h), *digests, parts[2]))
        if rows:
            conv, begins, first, turns, *lists = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(begins), pa.array(first, pa.int64()), pa.array(turns, pa.int64()),
                 *(_list_array(list(x)) for x in lists)],
                names=["conv_id", "begins", "first", "turns", "x1", "x2", "chars"],
            )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Segments of the rebuilt conversations with the digests of all their prefixes.

    ``first`` is the depth of the first digest, ``turns`` the length of the whole conversation, and
    ``c1``, ``c2`` the digest of the prefix before the segment. Every conversation has one row that ``begins``.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("u1"), F.xxhash64(F.lit("turn"), text, role).alias("u2"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", "turn", "u1", "u2"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    packed = "conv_id long, part int, place long, size long, u1 array<long>, u2 array<long>, chars array<long>"
    packed = stored(turns.mapInArrow(_segments, packed), "segments")
    at = ["conv_id", "part", "place"]
    before = Window.partitionBy("conv_id").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.select(*at, "size").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = stored(starts, "starts")
    packed = packed.drop("size").join(starts.drop("size"), at)
    head = packed.where("conv_id % 100 = 0 and start < 5").select(
        F.col("conv_id").alias("base"), "start", F.posexplode(F.slice(F.arrays_zip("u1", "u2", "chars"), 1, 5)).alias("at", "turn")
    ).where("start + at < 5")
    head = head.groupBy("base").agg(
        F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("at"), "turn.u1", "turn.u2", "turn.chars"))).alias("head")
    )
    convs = starts.groupBy("conv_id").agg(F.sum("size").alias("own")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, "base": F.col("conv_id") - F.col("conv_id") % 100,
    })
    none = F.array().cast("array<long>")
    convs = convs.join(head, "base", "left").select("conv_id", "own", "h", *(
        F.coalesce(F.col(f"head.{name}"), none).alias(alias) for name, alias in (("u1", "b1"), ("u2", "b2"), ("chars", "b_chars"))
    ))
    paths = stored(packed.join(convs, "conv_id").mapInArrow(_paths, _PATHS), "paths")
    # Of a conversation in several segments, all but the first need the digests before them.
    own = paths.where(F.size("x1") > 0).select("conv_id", "first", F.element_at("x1", -1).alias("t1"), F.element_at("x2", -1).alias("t2"))
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    several = own.select(
        "conv_id", "first", (F.count("*").over(conv) > 1).alias("several"),
        *(F.bit_xor(f"t{i}").over(before).alias(f"c{i}") for i in (1, 2)),
    ).where("several")
    paths = paths.join(several, ["conv_id", "first"], "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("c1", "c2")} | {"several": F.coalesce("several", F.lit(False)) & (F.size("x1") > 0)}
    )
    return stored(paths, "digests")


def _whole(batch: pa.RecordBatch) -> list[list[np.ndarray]]:
    """Digests of a batch's segments, with what came before them put in."""
    return [
        [x ^ c for x, c in zip(_lists(batch.column(f"x{i}")), batch.column(f"c{i}").to_numpy(), strict=True)] for i in (1, 2)
    ]


def _counted(width: int):
    """Cells that a task's prefixes fall into: those met once, and those met again, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def emit() -> pa.RecordBatch:
            rows = []
            for row, own in enumerate(held):
                cells, counts = np.unique(np.concatenate(own).view(np.uint64) & np.uint64(width - 1), return_counts=True)
                block = (cells // CELLS).astype(np.int64)
                low = (cells % CELLS).astype(np.uint16)
                for each in np.unique(block):
                    span = slice(*np.searchsorted(block, [each, each + 1]))
                    again = counts[span] > 1
                    rows.append((row, int(each), low[span][~again].tobytes(), low[span][again].tobytes()))
                own.clear()
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=["row", "block", "once", "again"]
            )

        for batch in batches:
            for own, digests in zip(held, _whole(batch), strict=True):
                own.extend(digests)
            size += sum(map(len, held[0][-batch.num_rows :])) if batch.num_rows else 0
            if size >= HELD:
                yield emit()
                size = 0
        if size:
            yield emit()

    return run


def _merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Bits of the cells of one block that two prefixes or more fall into."""
    counts = np.zeros(CELLS, np.uint8)
    for once, again in zip(frame["once"], frame["again"], strict=True):
        cells = np.frombuffer(once, np.uint16)
        counts[cells] = np.minimum(counts[cells] + 1, 2)
        counts[np.frombuffer(again, np.uint16)] = 2
    return pd.DataFrame([(*key, np.packbits(counts > 1).tobytes())], columns=["row", "block", "bits"])


def _sketch(paths: DataFrame) -> tuple[int, list[np.ndarray]]:
    """Cells of a row, and for each row the bits of the cells whose counter is two or more."""
    total = paths.agg(F.coalesce(F.sum(F.size("x1")), F.lit(0))).first()[0]
    width = min(MOST, max(LEAST, 1 << (SPARSE * max(1, total) - 1).bit_length()))
    cells = paths.select("x1", "x2", "c1", "c2").mapInArrow(_counted(width), "row int, block int, once binary, again binary")
    bits = [np.zeros(width // 8, np.uint8) for _ in range(2)]
    # As many rows as the sketch has blocks, whatever the number of prefixes.
    for row in cells.groupBy("row", "block").applyInPandas(_merged, "row int, block int, bits binary").toLocalIterator():
        at = row["block"] * CELLS // 8
        bits[row["row"]][at : at + CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return width, bits


def _proven(sketch: tuple[int, list[np.ndarray]], x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Digests whose estimate is one."""
    width, bits = sketch
    found = np.zeros(len(x1), bool)
    for digests, row in ((x1, bits[0]), (x2, bits[1])):
        cells = digests.view(np.uint64) & np.uint64(width - 1)
        found |= (row[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 0
    return found


def _marked(sketch):
    """Segments that hold a prefix whose estimate is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sketch.value)
        for batch in batches:
            found = [bool(_proven(known, *digests).any()) for digests in zip(*_whole(batch), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("first"), pa.array(found, pa.bool_())], names=["conv_id", "first", "found"]
            )

    return run


def _screened(sketch):
    """Prefixes that are proven to be in one conversation alone, and those that may be shared.

    ``tail`` tells of a prefix that may be shared whether the next one is proven alone and ends
    the conversation (1) or goes on (2), or is emitted as proven by the next segment (3).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sketch.value)
        for batch in batches:
            convs, firsts, turns, c1, c2 = (batch.column(name).to_numpy() for name in ("conv_id", "first", "turns", "c1", "c2"))
            before, chars = batch.column("proven").to_pylist(), _lists(batch.column("chars"))
            columns: list[list[np.ndarray]] = [[] for _ in range(10)]
            for i, (x1, x2) in enumerate(zip(*_whole(batch), strict=True)):
                n = len(x1)
                if not n:
                    continue
                # Whatever follows a proven prefix is alone.
                alone = np.maximum.accumulate(_proven(known, x1, x2) | before[i])
                depth = np.arange(firsts[i], firsts[i] + n)
                tail = np.zeros(n, np.int32)
                if firsts[i] > 1 and not before[i]:
                    # The parent is in another row and may be shared: it is looked up as if this prefix were, too.
                    tail[-1] = 3 * (n == 1 and alone[0] and depth[0] < turns[i])
                    alone[0] = False
                tail[:-1] = (alone[1:] & ~alone[:-1]) * np.where(depth[1:] == turns[i], 1, 2)
                # The first prefix that is proven alone follows from its parent's row.
                keep = ~alone | np.concatenate([[True], alone[:-1]])
                for column, values in zip(columns, (
                    np.full(n, convs[i]), depth, alone, depth == turns[i], x1, x2,
                    np.concatenate([c1[i : i + 1], x1[:-1]]), np.concatenate([c2[i : i + 1], x2[:-1]]), chars[i], tail,
                ), strict=True):
                    column.append(values[keep])
            if columns[0]:
                whole = [np.concatenate(column) for column in columns]
                hidden = whole[2]
                arrays = [pa.array(x) if k < 4 else pa.array(x, mask=hidden) for k, x in enumerate(whole)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["conv_id", "depth", "alone", "ends", "x1", "x2", "p1", "p2", "chars", "tail"]
                )

    return run


def _screen(paths: DataFrame) -> DataFrame:
    """All prefixes, with those that the sketch proves alone."""
    sketch = sent(paths.sparkSession, _sketch(paths))
    marks = paths.where("several").select("conv_id", "first", "x1", "x2", "c1", "c2").mapInArrow(
        _marked(sketch), "conv_id long, first long, found boolean"
    )
    before = Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("conv_id", "first", F.max("found").over(before).alias("proven")).where("proven")
    whole = paths.drop("several", "begins").join(marks, ["conv_id", "first"], "left").withColumn("proven", F.coalesce("proven", F.lit(False)))
    return stored(whole.mapInArrow(_screened(sketch), _SCREENED), "screened")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    while held := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), kinds, strict=True)], names=names
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversation numbers of each node, joined by commas, in pieces."""

    def rows() -> Iterator[tuple]:
        key, numbers = None, []
        for batch in batches:
            for *own, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if numbers and (own != key or len(numbers) >= PIECE // 8):
                    yield (*key, numbers[0], ",".join(map(str, numbers)).encode())
                    numbers = []
                key = own
                numbers.append(conv)
        if numbers:
            yield (*key, numbers[0], ",".join(map(str, numbers)).encode())

    return _batches(rows(), [*_KEY, "least", "piece"], [*[pa.int64()] * 4, pa.binary()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined pieces, which come in order and are read one after the other."""

    def rows() -> Iterator[tuple]:
        key, state = None, None
        for batch in batches:
            for *own, _, piece in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        yield (*key, state.hexdigest())
                    key, state = own, hashlib.sha256()
                state.update(piece)
        if key is not None:
            yield (*key, state.hexdigest())

    return _batches(rows(), [*_KEY, "ends_sha256"], [*[pa.int64()] * 3, pa.string()])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node that conversations end at.

    A hash is taken in order, so a node's numbers end in one task; what it reads are pieces that
    other tasks sorted and joined, one after the other, and it holds one of them at a time.
    """
    order = [*_KEY, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "depth long, x1 long, x2 long, least long, piece binary"
    )
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(
        _hashed, "depth long, x1 long, x2 long, ends_sha256 string"
    )


def _from_the_end(rows: DataFrame, *names: str) -> DataFrame:
    """Sums of the columns over a conversation's rows from each one's depth on.

    Rows are summed by runs of ``SEGMENT`` depths and the runs' totals then, so no window holds more.
    """
    rows = rows.withColumn("run", F.floor(F.col("depth") / SEGMENT))
    totals = rows.groupBy("conv_id", "run").agg(*(F.sum(name).alias(name) for name in names))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    behind = totals.select("conv_id", "run", *(F.sum(name).over(behind).alias(f"{name}_behind") for name in names))
    behind = behind.where(" or ".join(f"{name}_behind <> 0" for name in names))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(behind, ["conv_id", "run"], "left").withColumns({
        name: F.sum(name).over(inside) + F.coalesce(f"{name}_behind", F.lit(0)) for name in names
    })


def _sha(value: Column | str) -> Column:
    return F.sha2(F.col(value).cast("string") if isinstance(value, str) else value, 256)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns go by number, null first; turns of one number, repeated rows included, are all kept, in an
    order that only their contents decide. Null roles and texts are empty ones. Rows without a conv_id
    belong to no conversation. An empty table has no conversation and no node. For negative ids, c % 100 has
    the sign of c. Columns other than conv_id, turn, role and text are not read. Turns
    are told apart by two 64-bit codes of role and text, prefixes by 128 bits.
    """
    spark = conversations.sparkSession
    paths = rebuilt(conversations)
    convs, root = paths.agg(F.count_if("begins"), F.min("conv_id")).first()
    if root is None:
        return spark.createDataFrame([], (
            "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string"
        ))
    screened = _screen(paths)
    maybe = screened.where("not alone").drop("alone")
    groups = stored(maybe.groupBy(*_KEY).agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.count_if(F.col("tail") > 0).alias("tails"),
        *(F.max(name).alias(name) for name in ("p1", "p2", "chars")),
    ), "groups")
    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count("*").alias("children")
    )
    parents = groups.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("least").alias("parent"))
    nodes = groups.join(children, _KEY, "left").join(parents, ["depth", "p1", "p2"], "left").withColumns({
        "n_children": F.coalesce("children", F.lit(0)) + F.col("tails"),
        # A parent that isn't among the groups was proven to be of this conversation alone.
        "parent_conv_id": F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.coalesce("parent", "least")),
    })
    nodes = stored(nodes.select(*_KEY, "least", "parent_conv_id", "n_convs", "n_children", "chars"), "nodes")
    members = maybe.drop("chars", "p1", "p2").join(nodes.select(*_KEY, "least", "n_convs", "n_children", "chars"), _KEY)
    first = F.col("conv_id") == F.col("least")
    brought = members.select("conv_id", *_KEY, "least", "tail", "ends",
        F.when(first, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved_tokens"),
        F.when((F.col("tail") > 0) | (F.col("ends") & (F.col("n_children") == 0) & first), 1).otherwise(0).cast("long").alias("n_leaves"),
    )
    sums = _from_the_end(brought, "saved_tokens", "n_leaves").groupBy(*_KEY).agg(
        F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")
    )
    blank = F.lit(0).cast("long")
    turnless = paths.where("begins and turns = 0").select(*(blank.alias(name) for name in _KEY), "conv_id")
    hashes = stored(_end_hashes(maybe.where("ends").select(*_KEY, "conv_id").unionByName(turnless)), "ends")
    empty = F.lit(hashlib.sha256().hexdigest())
    shared = nodes.join(sums, _KEY).join(hashes, _KEY, "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    shared = stored(shared, "shared")

    def tail(conv_id: str, depth: Column, parent: Column, ends: Column):
        return (
            F.col(conv_id).alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            blank.alias("saved_tokens"), F.when(ends, _sha(conv_id)).otherwise(empty).alias("ends_sha256"),
        )

    alone = screened.where("alone")
    tails = alone.select(*tail("conv_id", F.col("depth"), F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("conv_id")), F.col("ends")))
    tops = members.where("tail in (1, 2)").select(*tail("conv_id", F.col("depth") + 1, F.col("least"), F.col("tail") == 1))
    own = alone.where("depth = 1").count()
    below = shared.where("depth = 1").agg(
        F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(0)), F.coalesce(F.sum("saved_tokens"), F.lit(0))
    ).first()
    ended = hashes.where("depth = 0").first()
    top = spark.createDataFrame(
        [(root, 0, None, convs, below[0] + own, (below[1] + own) or 1, below[2], ended["ends_sha256"] if ended else hashlib.sha256().hexdigest())],
        shared.schema,
    )
    return shared.unionByName(tails).unionByName(tops).unionByName(top)

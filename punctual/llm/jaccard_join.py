"""Similarity join of documents on the Jaccard of their word shingles, by rare-first prefix filtering.

1. ``profiles``: every text becomes its set of distinct shingles; equal sets become one.
2. ``shared_sets``: shingles meet by code range, where their document frequency is counted, and
   those of two sets or more go back to their sets. Shingles of one set alone come first in the
   rare-first order and can join nothing, so a set with a quarter of such shingles is done.
3. ``_links``: prefixes meet by shingle. A bucket first pairs each member with the hub of its class
   of sizes and of the next: the member with the fewest rarer shingles, which in a group of near
   copies is the one most like the rest. The pairs found make provisional groups. A few rounds pair
   the members of a bucket's lesser groups with members of its largest, drawn by lot. Then all members of different groups are
   paired, from the bucket's lesser groups outwards, so a bucket of one large group costs
   nothing more. A pair meets only at the first of a run of shingles that both prefixes share, as
   those of a common passage do. Length and position are tested in the join, the suffix on distinct pairs, and
   each pair that remains is verified once on the whole sets.

No bucket, group or candidate list is capped. Shingles in more than one set of ``HOT_SHARE``
are summed per task first and never meet in one place; their list is bounded by
``HOT_SHARE`` times the mean set size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.components import components
from punctual.llm.shingles import WordCodes, shingle_sets
from punctual.llm.store import give_back, stored

#: A shingle is hot if more than one set of so many has it.
HOT_SHARE = 2000
#: Sets with the shingle, among those counted at a time, from which a task reports it as maybe hot.
HOT_IN_TASK = 4
#: Shingles that a block of a map task holds, that it counts at a time, and that a code range is planned for.
BLOCK, HELD, RANGE = 1 << 20, 1 << 21, 1 << 21
#: Rounds in which groups meet by members drawn by lot before all that is left is paired.
ROUNDS = 1
#: Members of the largest group that are drawn in a round for each shingle.
HEADS = 8
#: Cells of the histogram that the suffix filter compares.
CELLS = 64

_PROFILE = "doc_id long, set_key binary, n_shingles long, token long, sets long"
_BLOCKS = "part int, header boolean, keys binary, counts binary, tokens binary, more binary"
_SETS = "set_key binary, n long, alone long, tokens binary, cells binary, prefix array<long>"


def _key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    known, seen, held, size = WordCodes(), set(), [], 0

    def frequent() -> pa.RecordBatch:
        tokens, sets = np.unique(np.concatenate(held), return_counts=True)
        often = sets >= HOT_IN_TASK
        none = pa.nulls(int(often.sum()))
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()),
             pa.array(tokens[often].view(np.int64)), pa.array(sets[often])],
            names=["doc_id", "set_key", "n_shingles", "token", "sets"],
        )

    for batch in batches:
        keys, counts = [], []
        for tokens in shingle_sets(batch.column(1).to_pylist(), known):
            key = _key(tokens)
            keys.append(key)
            counts.append(len(tokens))
            if key not in seen and len(tokens):
                seen.add(key)
                held.append(tokens)
                size += len(tokens)
            if size >= HELD:
                yield frequent()
                held, size, seen = [], 0, set()
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), none, none],
            names=["doc_id", "set_key", "n_shingles", "token", "sets"],
        )
    if held:
        yield frequent()
    del known, seen, held
    give_back()


def profiles(docs: DataFrame) -> DataFrame:
    """Set key and size of each row, and shingles that a task found often (rows with ``token``)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_profile, _PROFILE)


def _dealt(keys: list[bytes], sizes: np.ndarray, parts: int) -> list[np.ndarray]:
    """Indexes of the sets that go to each assembly part."""
    part = np.frombuffer(b"".join(keys), np.uint32)[::4] % parts
    return [np.flatnonzero(part == each) for each in range(parts)]


def _blocks(hot: np.ndarray, bits: int):
    """Map side: blocks of shingles by code range, and headers of the sets by assembly part."""
    parts = 1 << bits

    def emit(held: list[tuple[bytes, np.ndarray]]) -> Iterator[tuple]:
        keys, sets = [key for key, _ in held], [tokens for _, tokens in held]
        joined = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sets])
        is_hot = np.isin(tokens, hot)
        lengths = np.array([len(x) for x in sets], np.uint32)
        hots = np.bincount(owner[is_hot], minlength=len(sets)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(hots, dtype=np.int64)])
        hot_tokens = tokens[is_hot]
        for part, own in enumerate(_dealt(keys, lengths, parts)):
            if len(own):
                chosen = np.concatenate([hot_tokens[ends[i] : ends[i + 1]] for i in own])
                yield (part, True, joined[own].tobytes(), lengths[own].tobytes(), chosen.tobytes(), hots[own].tobytes())
        tokens, owner = tokens[~is_hot], owner[~is_hot]
        part = (tokens & np.uint64(parts - 1)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        tokens, owner = tokens[order], owner[order]
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for each in range(parts):
            span = slice(ends[each], ends[each + 1])
            if span.start < span.stop:
                own, counts = np.unique(owner[span], return_counts=True)
                # The range is known from the low bits, so the two lowest bytes stay behind.
                body = np.ascontiguousarray(tokens[span]).view(np.uint8).reshape(-1, 8)[:, 2:]
                yield (each, False, joined[own].tobytes(), counts.astype(np.uint32).tobytes(), body.tobytes(), b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, held, size = WordCodes(), set(), [], 0

        def batch_of(rows) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                names=["part", "header", "keys", "counts", "tokens", "more"],
            )

        for batch in batches:
            for tokens in shingle_sets(batch.column(0).to_pylist(), known):
                key = _key(tokens)
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                held.append((key, tokens))
                size += len(tokens)
                if size >= BLOCK:
                    yield batch_of(emit(held))
                    held, size = [], 0
            if len(seen) > 500_000:
                seen = set()
        if held:
            yield batch_of(emit(held))
        del known, seen, held
        give_back()

    return run


def _pairs_of_sets(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct keys of the blocks, and the rows (set index, index of the kept block entries)."""
    numbers: dict[bytes, int] = {}
    owners, kept = [], []
    for keys, counts in zip(frame["keys"], frame["counts"], strict=True):
        counts = np.frombuffer(counts, np.uint32)
        own = np.empty(len(counts), np.int64)
        fresh = np.empty(len(counts), bool)
        for i in range(len(counts)):
            key = keys[16 * i : 16 * i + 16]
            before = len(numbers)
            own[i] = numbers.setdefault(key, before)
            fresh[i] = len(numbers) > before
        owners.append(np.repeat(own, counts))
        kept.append(np.repeat(fresh, counts))
    return list(numbers), np.concatenate(owners), np.concatenate(kept)


def _counted(bits: int):
    """Reduce side of a code range: shingles of two sets or more, with their document frequency."""
    parts = 1 << bits

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "header", "keys", "counts", "tokens", "more"]
        give_back()
        if group[1]:
            return frame[columns]
        keys, owner, kept = _pairs_of_sets(frame)
        body = np.frombuffer(b"".join(frame["tokens"]), np.uint8).reshape(-1, 6)
        tokens = np.zeros((len(body), 8), np.uint8)
        tokens[:, 2:] = body
        tokens = tokens.view(np.uint64).ravel() | np.uint64(group[0])
        tokens, owner = tokens[kept], owner[kept]
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sets = np.diff(np.append(starts, len(tokens)))
        many = np.repeat(sets, sets)
        shared = many > 1
        tokens, owner, many = tokens[shared], owner[shared], many[shared]
        order = np.argsort(owner, kind="stable")
        tokens, many, owner = tokens[order], np.minimum(many[order], 65535).astype(np.uint16), owner[order]
        sizes = np.bincount(owner, minlength=len(keys)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        rows = []
        for part, own in enumerate(_dealt(keys, sizes, parts)):
            own = own[sizes[own] > 0]
            if len(own):
                spans = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in own])
                rows.append((part, False, b"".join(keys[i] for i in own), sizes[own].tobytes(),
                             tokens[spans].tobytes(), many[spans].tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return run


def _assembled(hot: np.ndarray, hot_sets: np.ndarray):
    """Sets of one part with all their shared shingles, if enough are shared to link at all."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        heads, rest = frame[frame["header"]], frame[~frame["header"]]
        numbers: dict[bytes, int] = {}
        sizes: list[int] = []
        found, owners, ranks = [], [], []
        for keys, counts, tokens, more in zip(heads["keys"], heads["counts"], heads["tokens"], heads["more"], strict=True):
            counts, more, tokens = (np.frombuffer(x, kind) for x, kind in ((counts, np.uint32), (more, np.uint32), (tokens, np.uint64)))
            at = 0
            for i in range(len(counts)):
                key = keys[16 * i : 16 * i + 16]
                if key not in numbers:
                    numbers[key] = len(sizes)
                    sizes.append(int(counts[i]))
                    own = tokens[at : at + more[i]]
                    found.append(own)
                    owners.append(np.full(len(own), numbers[key]))
                    ranks.append(65536 + hot_sets[np.searchsorted(hot, own)] if len(own) else np.empty(0, np.int64))
                at += more[i]
        for keys, counts, tokens, more in zip(rest["keys"], rest["counts"], rest["tokens"], rest["more"], strict=True):
            counts = np.frombuffer(counts, np.uint32)
            own = np.array([numbers[keys[16 * i : 16 * i + 16]] for i in range(len(counts))])
            owners.append(np.repeat(own, counts))
            found.append(np.frombuffer(tokens, np.uint64))
            ranks.append(np.frombuffer(more, np.uint16).astype(np.int64))
        sizes = np.array(sizes)
        tokens, owner, rank = np.concatenate(found), np.concatenate(owners).astype(np.int64), np.concatenate(ranks).astype(np.int64)
        order = np.lexsort((tokens, rank, owner))
        tokens, owner = tokens[order], owner[order]
        ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
        rows = []
        for key, i in numbers.items():
            own, n = tokens[ends[i] : ends[i + 1]], int(sizes[i])
            alone, needed = n - len(own), -(-3 * n // 4)
            if len(own) < needed:
                continue
            cells = np.bincount((own >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
            rows.append((key, n, alone, np.sort(own).tobytes(), cells.astype(np.uint32).tobytes(),
                         own[: n - needed + 1 - alone].view(np.int64)))
        return pd.DataFrame(rows, columns=["set_key", "n", "alone", "tokens", "cells", "prefix"])

    return run


def shared_sets(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """Distinct sets of which three quarters or more are shared with others, each with an ``id``."""
    sets = profile.where("token is null and n_shingles > 0").groupBy("set_key").agg(F.min("n_shingles").alias("n"))
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = (
        profile.where("token is not null").groupBy("token").agg(F.sum("sets").alias("sets"))
        .where(F.col("sets") * HOT_SHARE > max(count, HOT_SHARE * HOT_IN_TASK))
    )
    # At most total / (count / HOT_SHARE) rows: HOT_SHARE times the mean set size, at any scale.
    rows = often.collect()
    hot = np.array([row["token"] for row in rows], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_sets = hot[order], np.array([row["sets"] for row in rows], np.int64)[order]
    bits = max(3, int(np.ceil(np.log2(max(1, total) / RANGE))))
    blocks = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_blocks(hot, bits), _BLOCKS)
    counted = blocks.groupBy("part", "header").applyInPandas(_counted(bits), _BLOCKS)
    whole = counted.groupBy("part").applyInPandas(_assembled(hot, hot_sets), _SETS)
    return stored(whole.withColumn("id", F.monotonically_increasing_id()), "sets")


def _fits(a: str, b: str):
    """Length and position allow the pair to reach the similarity."""
    overlap = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return _lengths(a, b) & (7 * overlap >= 3 * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _lengths(a: str, b: str):
    """The sizes of the sets allow it."""
    return 4 * F.least(f"{a}.n", f"{b}.n") >= 3 * F.greatest(f"{a}.n", f"{b}.n")


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets truly reach 100 * intersection >= 75 * union."""
    for batch in batches:
        a, b, n, m, left, right = (column.to_pylist() for column in batch.columns)
        rows = np.empty(len(a), bool)
        for i in range(len(a)):
            first, second = np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64)
            if len(first) > len(second):
                first, second = second, first
            at = np.minimum(np.searchsorted(second, first), len(second) - 1)
            rows[i] = 7 * np.count_nonzero(second[at] == first) >= 3 * (n[i] + m[i])
        yield batch.filter(pa.array(rows)).select([0, 1])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs that pass the suffix filter, then the whole sets."""
    light = sets.select("id", "n", "cells")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = pairs.join(light.toDF("a", "n", "cells"), "a").join(light.toDF("b", "m", "more_cells"), "b")
    pairs = pairs.mapInArrow(_suffix, "a long, b long, n long, m long")
    whole = sets.select("id", "tokens")
    return (
        pairs.join(whole.toDF("a", "left"), "a").join(whole.toDF("b", "right"), "b")
        .select("a", "b", "n", "m", "left", "right").mapInArrow(_overlapping, "a long, b long")
    )


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shared shingles, cell by cell, can still overlap enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        b, a, n, x, m, y = batch.columns
        cells = [np.frombuffer(b"".join(side.to_pylist()), np.uint32).reshape(-1, CELLS) for side in (x, y)]
        most = np.minimum(*cells).sum(axis=1)
        rows = 7 * most >= 3 * (n.to_numpy() + m.to_numpy())
        yield pa.RecordBatch.from_arrays([a, b, n, m], names=["a", "b", "n", "m"]).filter(pa.array(rows))


def _links(sets: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between set ids whose components are those of all linked pairs."""
    shared = F.transform("prefix", lambda token, at: F.struct(token.alias("token"), at.alias("at"), F.get("prefix", at - 1).alias("before")))
    postings = sets.select("id", "n", "alone", F.inline(shared)).select(
        "token", "id", "n", (F.col("at") + F.col("alone")).alias("pos"), "before"
    )
    entry = F.struct("id", "n", "pos")
    hub = F.min(F.struct("pos", "id", "n")).alias("hub")
    hubs = postings.groupBy("token", _size_class("n").alias("size")).agg(hub, F.count("*").alias("members"))
    # Each class is offered its own hub and that of the next class; a lone set has nobody to meet.
    offers = hubs.groupBy("token").agg(F.sum("members").alias("all"), F.collect_list(F.struct("size", "hub")).alias("offers"))
    offered = offers.where("all > 1").select("token", F.explode("offers").alias("offer")).select(
        "token", F.explode(F.array("offer.size", F.col("offer.size") - 1)).alias("size"), "offer.hub"
    )
    met = postings.withColumn("size", _size_class("n")).withColumn("own", entry).join(offered, ["token", "size"])
    pairs = met.where((F.col("id") != F.col("hub.id")) & _fits("own", "hub"))
    near = stored(_verified(pairs.select(F.col("id").alias("a"), F.col("hub.id").alias("b")), sets), "near")
    grouped = _grouped(postings, near)
    for turn in range(ROUNDS):
        met = grouped.withColumn("own", entry).join(_mixed(grouped, turn), "token").where(F.col("root") != F.col("most.root"))
        met = met.select("id", "own", F.explode("most.heads").alias("head")).where(_fits("own", "head"))
        more = stored(_verified(met.select(F.col("id").alias("a"), F.col("head.id").alias("b")), sets), "more")
        if not more.isEmpty():
            near = stored(near.unionByName(more), "near")
            grouped = _grouped(postings, near)
    mixed = stored(grouped.join(_mixed(grouped, ROUNDS).select("token", F.col("most.root").alias("most")), "token"), "mixed")
    # Prefixes run in one order, so a pair that shares the shingles before, too, has met there. What is
    # left of two sets is most where they meet first: a pair that doesn't fit there fits nowhere.
    met = mixed.where("root <> most").alias("x").join(mixed.alias("y"), "token").where(
        "x.root <> y.root and (y.root = y.most or x.id < y.id) and not coalesce(x.before = y.before, false)"
    ).where(_fits("x", "y"))
    return near.unionByName(_verified(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), sets))


def _grouped(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the ``root`` of the group that the links so far put their set in."""
    groups = stored(components(links).toDF("id", "root"), "groups")
    return postings.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _size_class(n: str):
    """Sets of one class allow each other by length: classes are as wide as the similarity."""
    return F.floor(F.log(n) / math.log(4 / 3))


def _mixed(grouped: DataFrame, turn: int) -> DataFrame:
    """Buckets of more than one group, with the largest (``most``: its size, root and ``heads``).

    The heads are members drawn by lot, others in each turn; so are groups of one size.
    """
    def lot(name: str, draw: int):
        return F.xxhash64(name, F.lit(turn), F.lit(draw)).alias("lot")

    drawn = [F.min(F.struct(lot("id", draw), F.struct("id", "n", "pos").alias("head"))) for draw in range(HEADS)]
    heads = F.array_distinct(F.transform(F.array(*drawn), lambda one: one["head"])).alias("heads")
    sizes = grouped.groupBy("token", "root").agg(F.count("*").alias("size"), heads)
    return sizes.groupBy("token").agg(
        F.max(F.struct("size", lot("root", 0), "root", "heads")).alias("most"), F.count("*").alias("groups")
    ).where("groups > 1").drop("groups")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and the key ``set_key`` of each row's set.

    Two documents link when 100 * intersection >= 75 * union of their distinct five-word
    shingles; a component is what links reach, named by its smallest doc_id. A text of fewer
    words is one shingle. Null, empty or blank texts have no shingles, link with nothing and are
    their own component. Repeated rows are rows of the same set, each returned; a null doc_id
    stays null and names a component only if no other id is in it. An empty table gives no
    rows. Columns other than doc_id and text are not read. Shingles are told apart by 51 bits of
    their code or more within a pair, and sets by 128 bits.
    """
    profile = stored(profiles(docs), "profile")
    rows = profile.where("token is null").select("doc_id", "set_key", "n_shingles")
    sets = shared_sets(docs, profile)
    found = components(_links(sets)).join(sets.select(F.col("id").alias("node"), "set_key"), "node")
    members = stored(found.select("set_key", F.col("root").alias("component")), "members")
    ids = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    ids = ids.join(members, "set_key", "left")
    linked = ids.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least"))
    ids = ids.join(linked, "component", "left").select("set_key", F.coalesce("least", "first_id").alias("component_id"))
    return rows.join(ids, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_key",
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, all columns as they were.

    It is that of the smallest doc_id; a row without an id stays only if no row of its component
    has one. Rows are numbered before the join, and of equal ids the first number stays, so ids
    may repeat or miss. Rows without shingles stay, but once if they repeat both id and text.
    """
    number = "_row_key"
    while number in (name.lower() for name in docs.columns):
        number += "_"
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = similar_documents(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(number).alias("row"), "doc_id").join(found, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
    keep = ids.groupBy("component_id").agg(first).select(F.col("first.row").alias(number))
    kept = rows.join(keep, number, "left_semi").drop(number)
    blank = F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~blank).unionByName(kept.where(blank).dropDuplicates(["doc_id", "text"]))

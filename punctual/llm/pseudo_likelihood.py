"""Scores of documents by masked pseudo-likelihood under a bidirectional window network.

A word is one token if the vocabulary holds it, and else the longest pieces of the vocabulary
from its start on; single bytes are always pieces, and byte 0 ends a word. Every word is masked
as a whole and predicted from both of its sides: each of its tokens from the tokens before it
(earlier ones of its own word too) and from those that follow the word. Tables of both sides'
tokens add up to a hidden layer, from which a softmax over classes of the vocabulary and one
within the class give the token's probability.

Words, pieces and their frequencies come from every word of the corpus. The network is trained
in numpy where the texts are: each task learns from every token of its texts, and the tasks'
weights are averaged by the tokens they saw, for ``ROUNDS`` rounds. No task or driver sees the
corpus.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.store import sent, stored

#: Tokens of the vocabulary (a multiple of CLASS), tokens of a class, hidden units, tokens seen on each side.
WORDS, CLASS, HIDDEN, SIDE = 4096, 64, 24, 2
#: Rounds over all tokens, tokens of a step, and the step size.
ROUNDS, STEP, RATE = 1, 4096, 0.2
#: Single bytes, and whole words at most; the pieces have the rest. Lengths of pieces.
BYTES, WHOLE, LENGTHS = 256, (WORDS - 256) // 2, (2, 3, 4)
#: Words whose tokens a task remembers, and their greatest length.
REMEMBERED, SHORT = 300_000, 64
#: Tokens worked on at once when scoring, and distinct words (or places of pieces) that a task counts before it passes them on.
CHUNK, COUNTED, PLACES = 1 << 15, 500_000, 1 << 22
#: Rows whose chances, and whose changes, are worked out at once: their logits stay in a core's memory.
ROWS, FITTING = 1024, 512
#: Bytes of texts that are parted into words at once, and words that are turned into windows at once, or one text beyond.
PARTED, WINDOWS = 1 << 23, 1 << 15
#: Logits beyond which a row's greatest is taken off first, and places of a token up to which its changes are added place by place.
RANGE, FEW = 60.0, 8
#: Parts in which the weights are averaged.
SLICES = 16

#: Places of the network's input table: the tokens, then the border of a text. The first tokens are the bytes.
BORDER = WORDS
CLASSES = WORDS // CLASS


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of ``PARTED`` bytes together, or one text beyond."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PARTED, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the place there of every word in order, and each text's number of words.

    The words are those of ``words_of``: Arrow parts at the same six characters, and leaves empty strings at a text's ends.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    words, counts = parts.flatten(), pc.list_value_length(parts).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), counts)[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), np.bincount(owner, minlength=len(texts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each task with their counts."""
    found: dict[bytes, int] = {}

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "tokens"])

    for batch in batches:
        for block in _blocks(batch.column(0)):
            words, places, _ = _worded(block)
            often = np.bincount(places, minlength=len(words)).tolist()
            for word, n in zip(words.to_numpy(zero_copy_only=False).tolist(), often, strict=True):
                found[word] = found.get(word, 0) + n
            if len(found) >= COUNTED:
                yield flushed()
                found = {}
    yield flushed()


def _pieced(known: set[bytes]):
    """Pieces of the words outside ``known`` with their counts, each as a number: its length, then its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            key, often = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *times])
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            found, total = key[starts], np.add.reduceat(often[order], starts) if len(key) else often
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["piece", "tokens"])

        for batch in batches:
            rows = [(word, n) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if word not in known]
            if not rows:
                continue
            data = np.frombuffer(b"\0".join(word for word, _ in rows) + b"\0", np.uint8).astype(np.int64)
            lengths = [len(word) + 1 for word, _ in rows]
            owner, often = np.repeat(np.arange(len(rows)), lengths), np.repeat([n for _, n in rows], lengths)
            for length in LENGTHS:
                if len(data) < length:
                    continue
                ends = len(data) - length + 1
                key = np.full(ends, length, np.int64)
                for step in range(length):
                    key = key << 8 | data[step : step + ends]
                own = owner[:ends] == owner[length - 1 :]
                keys.append(key[own])
                times.append(often[:ends][own])
                size += len(keys[-1])
            if size >= PLACES:
                yield flushed()
                keys, times, size = [], [], 0
        yield flushed()

    return run


def _piece(key: int) -> bytes:
    """The piece of a number."""
    data = key.to_bytes(8, "big").lstrip(b"\0")
    return data[1:]


class Tokens(dict):
    """Tokens of each word: its own, or the longest pieces from its start on."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers, self.whole, self.tree = numbers, None, None

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        whole, number = word + b"\0", self.numbers.get
        own = number(whole)
        if own is not None:
            found = (own,)
        else:
            parts, at = [], 0
            while at < len(whole):
                for length in reversed(LENGTHS):
                    part = number(whole[at : at + length]) if at + length <= len(whole) else None
                    if part is not None:
                        break
                else:
                    part, length = whole[at], 1
                parts.append(part)
                at += length
            found = tuple(parts)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


    def of_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words in order, and each word's number of them: the same as one by one, worked out together."""
        if self.whole is None:
            self.whole = {part[:-1]: number for part, number in self.numbers.items() if part[-1:] == b"\0"}
            self.tree = Tree(self.numbers)
        own = np.array(list(map(self.whole.get, words, itertools.repeat(-1))), np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        lengths = np.ones(len(words), np.int64)
        spelt = (own < 0) & (sizes <= SHORT + 1)
        places = np.flatnonzero(spelt)
        short, counts = _spelt([words[i] for i in places.tolist()], sizes[places], self.tree)
        lengths[places] = counts
        # Few words are longer, but each may be as long as a text.
        places = np.flatnonzero((own < 0) & ~spelt)
        long = [self[words[i]] for i in places.tolist()]
        lengths[places] = [len(x) for x in long]
        kind = np.repeat(np.where(own >= 0, 0, np.where(spelt, 1, 2)), lengths)
        found = np.empty(len(kind), np.int32)
        found[kind == 0], found[kind == 1], found[kind == 2] = own[own >= 0], short, [i for x in long for i in x]
        return found, lengths


class Tree:
    """Pieces by their bytes: ``after`` has the place reached from a place by a byte, 0 where no piece goes on, and ``ends`` the token of the piece that ends there."""

    def __init__(self, numbers: dict[bytes, int]):
        places = {b"": 1}
        pieces = [part for part in numbers if len(part) <= max(LENGTHS)]
        for part in pieces:
            for length in range(1, len(part) + 1):
                places.setdefault(part[:length], len(places) + 1)
        self.after, self.ends = np.zeros((len(places) + 1, 256), np.int32), np.full(len(places) + 1, -1, np.int32)
        for part, place in places.items():
            if part:
                self.after[places[part[:-1]], part[-1]] = place
        for part in pieces:
            self.ends[places[part]] = numbers[part]


def _spelt(words: list[bytes], sizes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Longest pieces from each word's start on, in order, and each word's number of them; sizes include the end's byte."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    stops = np.cumsum(sizes)
    left = np.repeat(stops, sizes) - np.arange(len(data))
    # The longest piece from every byte on, if any.
    token, step, place = data.astype(np.int32), np.ones(len(data), np.int64), tree.after[1][data]
    after = tree.after.reshape(-1)
    for length in LENGTHS:
        key = data[length - 1 :]
        place = after.take((place[: len(key)].astype(np.int64) << 8) + key)
        number = tree.ends.take(place)
        hits = np.flatnonzero((number >= 0) & (left[: len(key)] >= length))
        token[hits], step[hits] = number[hits], length
    first, at, stop = np.zeros(len(data), bool), stops - sizes, stops
    while len(at):
        first[at] = True
        at = at + step[at]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    return token[first], np.add.reduceat(first, stops - sizes, dtype=np.int64)


def _frequencies(numbers: dict[bytes, int]):
    """Times that each token stands in the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(numbers), np.zeros(WORDS, np.int64)
        for batch in batches:
            found, lengths = tokens.of_all(batch.column(0).to_numpy(zero_copy_only=False).tolist())
            total += np.bincount(found, np.repeat(batch.column(1).to_numpy(), lengths), WORDS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WORDS)), pa.array(total)], names=["token", "times"])

    return run


class Network:
    """Weights of the window network; ``arrays`` in a fixed order."""

    SHAPES = ((2 * SIDE, WORDS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CLASS), (CLASSES, CLASS))

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    @classmethod
    def started(cls, shares: np.ndarray, seed: int = 1) -> Network:
        """Small random tables, and output biases that give the tokens' frequencies."""
        random = np.random.default_rng(seed)
        by_class = shares.reshape(CLASSES, CLASS)
        totals = by_class.sum(axis=1)
        arrays = [(random.normal(size=shape) * 0.1).astype(np.float32) for shape in cls.SHAPES]
        arrays[1][:] = 0
        arrays[3] = np.log(totals).astype(np.float32)
        arrays[5] = np.log(by_class / totals[:, None]).astype(np.float32)
        return cls(arrays)

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(shape)) for shape in cls.SHAPES])
        return cls([part.reshape(shape).copy() for part, shape in zip(np.split(flat, ends[:-1]), cls.SHAPES, strict=True)])

    def packed(self) -> np.ndarray:
        return np.concatenate([array.ravel() for array in self.arrays])

    def hidden(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden units of the places of all tables; and the same with a last one that is always 1 and carries the biases."""
        tables, bias = self.arrays[:2]
        seen = tables.reshape(-1, HIDDEN).take(flat, axis=0)
        units = seen[0]
        for k in range(1, 2 * SIDE):
            units += seen[k]
        units += bias
        np.tanh(units, out=units)
        found = np.empty((len(units), HIDDEN + 1), np.float32)
        found[:, :HIDDEN], found[:, HIDDEN] = units, 1
        return units, found

    def biased(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the two softmax layers with their biases as a last row."""
        _, _, into, into_bias, within, within_bias = self.arrays
        return np.concatenate([into, into_bias[None]]), np.concatenate([within, within_bias[:, None]], axis=1)

    def scores(self, ids: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Log-probability of each id between its sides."""
        into, within = self.biased()
        # Rows go by their classes, few at a time, which stay in the processor's memory.
        group = ids // CLASS
        order, ends = _sorted(group, CLASSES)
        group, place, flat = group[order], (ids % CLASS)[order], _flat(sides.take(order, axis=1))
        wide, inner, ordered = _wide(into), _wide(within), np.empty(len(ids))
        for i in range(0, len(ids), ROWS):
            rows = slice(i, i + ROWS)
            _, hidden = self.hidden(flat[:, rows])
            found = _chances(hidden @ into, group[rows], wide).astype(np.float64)
            for each in range(group[i], group[min(i + ROWS, len(ids)) - 1] + 1):
                own = slice(max(ends[each] - i, 0), max(min(ends[each + 1] - i, ROWS), 0))
                if own.start < own.stop:
                    found[own] += _chances(hidden[own] @ within[each], place[rows][own], inner)
            ordered[rows] = found
        found = np.empty(len(ids))
        found[order] = ordered
        return found

    def learn(self, ids: np.ndarray, sides: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step down the mean cross-entropy, with step sizes from all squares so far."""
        size = len(ids)
        into, within = self.biased()
        # Rows go by their classes throughout.
        group = ids // CLASS
        order, ends = _sorted(group, CLASSES)
        group, place, flat = group[order], (ids % CLASS)[order], _flat(sides.take(order, axis=1))
        units, hidden = self.hidden(flat)
        wide, inner_wide = _wide(into), _wide(within)
        back, change, changes = np.empty_like(units), np.zeros_like(into), np.zeros_like(within)
        for classes in _runs(ends.tolist()):
            rows = slice(classes[0][1], classes[-1][2])
            seen = hidden[rows]
            # A row's gap is what stands here by its share: exponentials less their sum at the own place.
            gap = seen @ into
            share = _gaps(gap, group[rows], wide) / size
            own_back = back[rows]
            np.dot(gap, into[:HIDDEN].T, out=own_back)
            own_back *= share
            change += (seen * share).T @ gap
            for each, start, stop in classes:
                np.dot(hidden[start:stop], within[each], out=gap[start - rows.start : stop - rows.start])
            share = _gaps(gap, place[rows], inner_wide) / size
            scaled, inner = seen * share, np.empty_like(own_back)
            for each, start, stop in classes:
                own = slice(start - rows.start, stop - rows.start)
                np.dot(gap[own], within[each, :HIDDEN].T, out=inner[own])
                np.dot(scaled[own].T, gap[own], out=changes[each])
            inner *= share
            own_back += inner
        units *= units
        np.subtract(1, units, out=units)
        back *= units
        # Rows of tokens that aren't there have no change.
        tables, table_squares = self.arrays[0].reshape(-1, HIDDEN), squares[0].reshape(-1, HIDDEN)
        words, table_change = _summed(back, flat)
        square = table_squares.take(words, axis=0)
        square += table_change * table_change
        table_squares[words] = square
        tables[words] -= _moved(table_change, square)
        dense = back.sum(axis=0), change[:HIDDEN], change[HIDDEN], changes[:, :HIDDEN], changes[:, HIDDEN]
        for array, moved, square in zip(self.arrays[1:], dense, squares[1:], strict=True):
            square += moved * moved
            array -= _moved(moved, square)


def _runs(ends: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Neighbouring classes with the rows where each begins and ends, about ``FITTING`` rows together."""
    run = []
    for each, (start, stop) in enumerate(itertools.pairwise(ends)):
        if start < stop:
            run.append((each, start, stop))
            if stop - run[0][1] >= FITTING:
                yield run
                run = []
    if run:
        yield run


def _flat(sides: np.ndarray) -> np.ndarray:
    """Places of the sides in the rows of all tables."""
    return sides + np.arange(0, 2 * SIDE * (WORDS + 1), WORDS + 1)[:, None]


def _moved(change: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The step against a change whose squares so far add up to ``square``."""
    root = np.sqrt(square)
    root += 1e-4
    np.divide(change, root, out=root)
    root *= RATE
    return root


def _summed(rows: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of ``flat``, whose columns are the rows', and the sum of the rows of each."""
    places = flat.ravel().astype(np.uint16)
    order = np.argsort(places, kind="stable")
    places = places[order]
    bounds = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1, [len(places)]])
    starts, counts = bounds[:-1], bounds[1:] - bounds[:-1]
    # Those with most rows come first, so those with more than so many are the first ones.
    ranks = np.argsort((FEW - counts).clip(-1).astype(np.int8), kind="stable")
    starts, counts = starts[ranks], counts[ranks]
    order = np.tile(np.arange(len(rows)), len(flat))[order]
    found = rows.take(order[starts], axis=0)
    many = int((counts > FEW).sum())
    for nth in range(1, FEW):
        more = int((counts > nth).sum())
        if more == many:
            break
        found[many:more] += rows.take(order[starts[many:more] + nth], axis=0)
    if many:
        # Adding pairs of numbers as complex ones takes half the loops.
        begins = np.cumsum(counts[:many]) - counts[:many]
        at = np.repeat(starts[:many] - begins, counts[:many])
        held = rows.take(order[at + np.arange(len(at))], axis=0).view(np.complex64)
        found[:many] = np.add.reduceat(held, begins, axis=0).view(np.float32)
    return places[starts].astype(np.int64), found


def _sorted(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the numbers in their order, and where each of the numbers below ``size`` begins and ends."""
    # Of two bytes numpy sorts by digits.
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=size))])


def _wide(layer: np.ndarray) -> bool:
    """Whether exponentials of the layer's logits might leave the range of single precision; units are between -1 and 1."""
    return bool((np.ones(HIDDEN + 1, np.float32) @ np.abs(layer)).max() > RANGE)


def _steady(logits: np.ndarray) -> None:
    """Takes each row's greatest off."""
    logits -= logits.max(axis=1, keepdims=True)


def _raised(logits: np.ndarray) -> np.ndarray:
    """Turns the logits into exponentials; returns each row's sum."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _gaps(logits: np.ndarray, places: np.ndarray, wide: bool) -> np.ndarray:
    """Turns the logits into softmax less 1 at each row's place, but for a factor of the row, which it returns."""
    if wide:
        _steady(logits)
    total = _raised(logits)
    logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + places] -= total
    return 1 / total[:, None]


def _chances(logits: np.ndarray, places: np.ndarray, wide: bool) -> np.ndarray:
    """Logarithm of each row's chance of its place."""
    if wide:
        _steady(logits)
    found = logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + places]
    return found - np.log(_raised(logits))


class Model:
    """Vocabulary and the network."""

    def __init__(self, parts: list[bytes], network: Network):
        # The bytes come first; whole words (with their end) and pieces follow.
        self.numbers = {part: BYTES + i for i, part in enumerate(parts)}
        self.tokens, self.network = Tokens(self.numbers), network

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens of a text, those on their sides, and the log-probability of what has no sides: nothing, so 0."""
        parts = [self.tokens[word] for word in words]
        sizes = np.array([len(x) for x in parts], np.int64)
        ids = np.fromiter((i for x in parts for i in x), np.int32, int(sizes.sum()))
        border = np.full(SIDE, BORDER, np.int32)
        padded = np.concatenate([border, ids, border])
        # The right side of all tokens of a word begins after the word, so none sees what it shall predict.
        ends = np.repeat(np.cumsum(sizes), sizes)
        sides = np.stack([*(padded[k : k + len(ids)] for k in range(SIDE)), *(padded[ends + SIDE + k] for k in range(SIDE))])
        return ids, sides, 0.0

    def read_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of the texts in order, those on their sides, and each text's number of tokens and of words; some texts at a time."""
        for block in _blocks(texts):
            distinct, places, n_words = _worded(block)
            held, lengths = self.tokens.of_all(distinct.to_numpy(zero_copy_only=False).tolist())
            begins, ends, start = np.cumsum(lengths) - lengths, np.concatenate([[0], np.cumsum(n_words)]), 0
            while start < len(block):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WINDOWS, "right")) - 1)
                yield *_around(places[ends[start] : ends[stop]], n_words[start:stop], held, begins, lengths), n_words[start:stop]
                start = stop


def _around(places: np.ndarray, n_words: np.ndarray, held: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts whose words are at the places in ``held``, those on their sides, and each text's number of tokens."""
    sizes = lengths[places]
    # Where each word's tokens end, in the texts and with the borders before, between and after them.
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    ids = held[np.repeat(begins[places] - ends + sizes, sizes) + np.arange(total)]
    shift = SIDE * np.repeat(np.arange(1, len(n_words) + 1), n_words)
    padded = np.full(total + SIDE * (len(n_words) + 1), BORDER, np.int32)
    at = np.arange(total) + np.repeat(shift, sizes)
    padded[at] = ids
    # The right side of all tokens of a word begins after the word, so none sees what it shall predict.
    after = np.repeat(ends + shift, sizes)
    sides = np.empty((2 * SIDE, total), np.int32)
    for k in range(SIDE):
        sides[k], sides[SIDE + k] = padded[at - SIDE + k], padded[after + k]
    return ids, sides, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])])


def _windows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all tokens of the task's texts, in steps or more at a time."""
    ids, sides, size = [], [], 0
    for batch in batches:
        for own, around, sizes, _ in model.read_all(batch.column(0)):
            start = stop = 0
            for tokens in sizes.tolist():
                stop += tokens
                if tokens and size + stop - start >= STEP:
                    yield np.concatenate([*ids, own[start:stop]]), np.concatenate([*sides, around[:, start:stop]], axis=1)
                    ids, sides, size, start = [], [], 0, stop
            if start < stop:
                ids.append(own[start:])
                sides.append(around[:, start:])
                size += stop - start
    if size:
        yield np.concatenate(ids), np.concatenate(sides, axis=1)


def _trained(model):
    """A task's weights after its windows, in slices, with the tokens that they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        squares = [np.full_like(array, 1e-6) for array in own.network.arrays]
        tokens = 0
        for ids, sides in _windows(own, batches):
            for start in range(0, len(ids), STEP):
                own.network.learn(ids[start : start + STEP], sides[:, start : start + STEP], squares)
            tokens += len(ids)
        if tokens:
            parts = np.array_split(own.network.packed(), SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array([part.tobytes() for part in parts], pa.binary())],
                names=["slice", "tokens", "weights"],
            )

    return run


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    total = frame["tokens"].sum()
    mean = sum(np.frombuffer(weights, np.float32) * (tokens / total) for weights, tokens in zip(frame["weights"], frame["tokens"], strict=True))
    return pd.DataFrame([(int(frame["slice"].iloc[0]), int(total), mean.astype(np.float32).tobytes())], columns=["slice", "tokens", "weights"])


def trained(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Vocabulary from all words, network from every token of all texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counts = stored(texts.mapInArrow(_counted, "word binary, tokens long").groupBy("word").agg(F.sum("tokens").alias("tokens")), "words")
    words = [bytes(row["word"]) for row in counts.orderBy(F.desc("tokens"), "word").limit(WHOLE).collect()]
    pieces = counts.mapInArrow(_pieced(set(words)), "piece long, tokens long").groupBy("piece").agg(F.sum("tokens").alias("tokens"))
    # Pieces go by the bytes that they save.
    saved = F.col("tokens") * (F.when(F.col("piece") < 3 << 16, 1).when(F.col("piece") < 4 << 24, 2).otherwise(3))
    whole = [word + b"\0" for word in words]
    best = pieces.orderBy(F.desc(saved), "piece").limit(WORDS - BYTES - len(whole)).collect()
    # A short word and a piece at the end of words may be the same bytes.
    parts = list(dict.fromkeys(whole + [_piece(row["piece"]) for row in best]))
    shares = np.ones(WORDS)
    numbers = {part: BYTES + i for i, part in enumerate(parts)}
    for token, times in counts.mapInArrow(_frequencies(numbers), "token long, times long").groupBy("token").agg(F.sum("times")).collect():
        shares[token] += times
    model = Model(parts, Network.started(shares / shares.sum()))
    schema = "slice int, tokens long, weights binary"
    for _ in range(rounds):
        learnt = texts.mapInArrow(_trained(sent(spark, model)), schema)
        # Tasks are averaged in groups first, so no task gathers more than a bounded number of them.
        groups = learnt.withColumn("group", F.pmod(F.xxhash64("weights"), F.lit(64)))
        means = groups.groupBy("slice", "group").applyInPandas(_averaged, schema)
        slices = means.groupBy("slice").applyInPandas(_averaged, schema).orderBy("slice").collect()
        if slices:
            model.network = Network.unpacked(np.concatenate([np.frombuffer(row["weights"], np.float32) for row in slices]))
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)

        for batch in batches:
            sums, sizes = [np.empty(0)], [np.empty(0, np.int64)]
            # Texts share chunks, so short ones cost little.
            for ids, sides, tokens, n_words in own.read_all(batch.column(1)):
                found = [own.network.scores(ids[i : i + CHUNK], sides[:, i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]
                sums.append(np.bincount(np.repeat(np.arange(len(tokens)), tokens), np.concatenate([np.empty(0), *found]), len(tokens)))
                sizes.append(n_words)
            sums, sizes = np.concatenate(sums), np.concatenate(sizes)
            none = sizes == 0
            mean = sums / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(sums), pa.array(mean, mask=none), pa.array(np.exp(np.minimum(-mean, 700)), mask=none)],
                names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood", "perplexity"],
            )

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_likelihood`` (sum over all tokens of all words), its mean over the words and ``perplexity``.

    Words are those of the shingles: runs without white space, A-Z lower-cased. A text without
    words has a sum of 0 and null mean and perplexity. Repeated rows score alike; null ids are
    returned; an empty table gives no rows. Texts are scored whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double, perplexity double"
    return rows.mapInArrow(_scored(sent(docs.sparkSession, model)), schema)

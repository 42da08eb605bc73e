"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs whose tokens a task remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 400_000

#: Fixed value: the split of the published byte-level tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The characters that the split takes as white space. No piece crosses the border of the runs
#: below, so a run is split and encoded once and then looked up whole.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(rest)}


class Coder:
    """Exact merges of one vocabulary, in time linear in the piece.

    A piece is covered left to right by the longest token that starts where the last one ends
    and that may follow it. If none may, the last token gives way to its next shorter prefix,
    and the position it led to is never tried again, so each is visited a bounded number of
    times. Two tokens may stand together if undoing their merges from the latest back never
    meets a pair that would have been merged across the border first.
    """

    def __init__(self, vocabulary: bytes):
        file = json.loads(vocabulary)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in file["added_tokens"]}
        spelled = {spelling: bytes(letters[c] for c in spelling) for spelling in vocab if spelling not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for spelling, token in vocab.items():
            if spelling in spelled:
                self.bytes[token] = spelled[spelling]
        for spelling, token in self.special.items():
            self.bytes[token] = spelling.encode()
        self.halves = [(token, token) for token in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        # The rank of a merge orders it; ids of a trained vocabulary need not.
        self.rank = [-1] * size
        for rank, (left, right) in enumerate(map(tuple, file["model"]["merges"])):
            token, pair = vocab[left + right], (vocab[left], vocab[right])
            self.merged[pair] = token
            if self.rank[token] < 0:
                self.rank[token], self.halves[token] = rank, pair
        self.matches = ahocorasick.Automaton()
        known = {spelled[spelling].decode("latin-1"): token for spelling, token in vocab.items() if spelling in spelled}
        # The automaton walks the longest way into any token; the table has the longest token on each way.
        self.token_of = {word[:n]: -1 for word in known for n in range(1, len(word))} | known
        for way in sorted((way for way, token in self.token_of.items() if token < 0), key=len):
            self.token_of[way] = self.token_of[way[:-1]]
        for word, token in known.items():
            self.matches.add_word(word, token)
        self.matches.make_automaton()
        self.shorter = [-1] * size
        for word, token in known.items():
            self.shorter[token] = self.token_of[word[:-1]] if len(word) > 1 else -1
        self.widest = max(map(len, self.bytes))
        self.sizes = [len(word) for word in self.bytes]
        self.lengths = np.array([len(word) for word in self.bytes], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.together: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.runs: dict[str, tuple[int, ...]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges would leave these two tokens side by side."""
        asked = (left, right)
        if (known := self.together.get(asked)) is not None:
            return known
        if len(self.together) >= REMEMBERED:
            self.together.clear()
        merged, rank, halves = self.merged, self.rank, self.halves
        limit, answer = (len(self.halves), 0), None
        while answer is None:
            joint = merged.get((left, right))
            # A merge of the same rank further left comes first, hence the second part of the limit.
            if joint is not None and (rank[joint], 1) < limit:
                answer = False
            elif rank[left] > rank[right]:
                limit, left = (rank[left], 0), halves[left][1]
            elif rank[right] >= 0:
                limit, right = (rank[right], 2), halves[right][0]
            else:
                answer = True
        self.together[asked] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode().decode("latin-1")
        size = len(data)
        reach, token_of, widest = self.matches.longest_prefix, self.token_of, self.widest
        sizes, shorter, together, may_follow = self.sizes, self.shorter, self.together, self.may_follow
        open_at = None
        tokens: list[int] = []
        at, token, last = 0, token_of[data[: reach(data[:widest])]], -1
        while True:
            while token >= 0:
                if open_at is None or open_at[at + sizes[token]]:
                    if last < 0:
                        break
                    follows = together.get((last, token))
                    if may_follow(last, token) if follows is None else follows:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += sizes[token]
                if at == size:
                    return tokens
                rest = data[at : at + widest]
                last, token = token, token_of[rest[: reach(rest)]]
            else:
                if open_at is None:
                    open_at = [True] * (size + 1)
                open_at[at] = False
                at -= sizes[last]
                token = shorter[tokens.pop()]
                last = tokens[-1] if tokens else -1

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the text; the strings of special tokens are those tokens."""
        ids: list[int] = []
        known = self.runs
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for run in RUNS(part):
                tokens = known.get(run)
                if tokens is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    tokens = tuple(token for piece in self.split(run) for token in self.encode_piece(piece))
                    if len(run) <= 64:
                        known[run] = tokens
                ids += tokens
        return np.array(ids, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: each token's bytes are gathered from the offset table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.spelling[places].tobytes().decode("utf-8", "replace")


def _coded(vocabulary, with_ids: bool):
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # ids of few texts at a time
                part = batch.slice(start, 256)
                counts, hashes, decoded, kept = [], [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    ids = coder.encode(text or "")
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                own = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    own.append(pa.array(kept, pa.list_(pa.int32())))
                columns = part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, *own], names=[*part.schema.names[:-1], *names])

    return run


def default_vocabulary() -> str:
    """File of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` (doc_id if not given) with n_tokens, ids_sha256 and decoded_sha256 of each text.

    ``with_ids`` adds the ids themselves as ``token_ids``. The ids are those of the public
    tokenizer without added special tokens, truncation or padding; the decoded text is the
    text of these ids. A null or empty text has no ids and the hashes of no bytes. Repeated rows
    and rows with a null doc_id are each returned; an empty table gives no rows; other columns
    are not read. Every text is coded whole. The vocabulary file, fixed in size, is read by the
    driver and sent to the tasks.
    """
    keep = ["doc_id"] if keep is None else keep
    file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())
    rows = docs.select(*[F.col(f"`{name}`") for name in keep], F.col("text").alias("_coded_text"))
    types = [f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1]]
    own = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["token_ids array<int>"] * with_ids]
    return rows.mapInArrow(_coded(file, with_ids), ", ".join([*types, *own]))

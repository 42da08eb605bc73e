"""The conversation trie against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from punctual.llm import prefix_trie as trie
from punctual.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract, word by word, for rows without repeated turn numbers."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [x[2:] for x in sorted(found)] for conv, found in turns.items()}
    members, ended = defaultdict(set), defaultdict(list)
    for conv, found in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple(own.get(conv - conv % 100, [])[:h] + found[h:])
        for depth in range(len(path) + 1):
            members[path[:depth]].add(conv)
        ended[path].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    return sorted((
        min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]), leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, sorted(ended[path]))).encode()).hexdigest(),
    ) for path, own in members.items())


def found(frame):
    return sorted(map(tuple, trie.prefix_trie(frame).collect()))


def shared_talk(n=230):
    """Conversations that repeat each other's turns in many ways, some short, one without turns left."""
    rows = []
    for conv in range(n):
        for turn in range(conv * 7 % 9 + 1):
            same = conv % 4 if turn < 3 else conv % (turn + 9)
            rows.append((conv, turn, ("user", "assistant")[turn % 2], f"é {turn} {same}" * (1 + same % 3)))
    rows += [(300 + conv, turn, "user", "all the same") for conv in range(40) for turn in range(8)]
    return rows + [(1000 + conv, 0, "user", "short") for conv in range(1, 7)]


@pytest.mark.parametrize("segment", [4096, 2])
def test_equals_a_plain_trie(spark, monkeypatch, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    rows = shared_talk()
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """A sketch with far too few cells proves little, and all the rest is grouped exactly."""
    monkeypatch.setattr(trie, "SEGMENT", 3)
    monkeypatch.setattr(trie, "_proven", lambda sketch, x1, x2: x1 % 3 == 0)
    rows = [(conv, turn, "user", f"{conv} {turn}") for conv in range(1, 90) for turn in range(conv % 11 + 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_given_table(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_conversation_trie(spark, sf_dir).collect())) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, 0, "user", ""), (1, 1, "user", "é😀" * 30000),
            (2, None, "", ""), (2, 0, "user", ""), (2, 1, "user", "é😀" * 30000), (2, 2, None, "x")]
    frame = spark.createDataFrame([(*row, 7, 7, 7) for row in rows], f"{SCHEMA}, depth long, x1 long, part long")
    assert found(frame) == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_repeated_rows_are_turns(spark):
    rows = [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a"), (7, 0, "user", "a")]
    depths = {5: 3 - min(3, zlib.crc32(b"5") % 6), 7: 1 - min(1, zlib.crc32(b"7") % 6)}
    assert max(row[1] for row in found(spark.createDataFrame(rows, SCHEMA))) == max(depths.values())

"""Words and word shingles of a text as 64-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
#: Words whose codes a task remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 400_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class WordCodes(dict):
    """Code of each word, worked out when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.split() parts at just these characters."""
    return text.lower().split() if text else []


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Code of each run of ``width`` codes, in order."""
    ends = len(codes) - width + 1
    with np.errstate(over="ignore"):
        folded = codes[:ends] + np.uint64(width)
        for step in range(1, width):
            folded = folded * _FACTOR + codes[step : step + ends]
        folded ^= folded >> np.uint64(32)
        folded *= _MIX
        folded ^= folded >> np.uint64(29)
    return folded


def shingle_codes(words: list[bytes], known: WordCodes, width: int = WIDTH) -> np.ndarray:
    """Codes of the shingles in order, repeats included; fewer words than ``width`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return rolled(codes, min(width, len(words)))


def shingle_sets(texts: Iterator[bytes | None], known: WordCodes) -> Iterator[np.ndarray]:
    """Sorted distinct shingle codes of each text."""
    for text in texts:
        yield np.unique(shingle_codes(words_of(text), known))

"""Word shingles of a batch of texts as 64-bit hashes, without a Python loop per shingle."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Longest runs of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it has grown large."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M3


def shingle_sets(texts: list[str | None], width: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by (text, hash); the text of each; the number per text."""
    lengths, flat = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        if text:
            words = WORD.findall(text.lower())
            lengths[i] = len(words)
            flat.extend(map(known.__getitem__, words))
    words = np.array(flat, dtype=np.uint64)
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    last = len(words) - width + 1
    h = np.full(last, width, dtype=np.uint64)
    for j in range(width):
        h = mixed(h * _M1 + words[j : j + last])
    inside = owner[:last] == owner[width - 1 :]
    h, owner = h[inside], owner[:last][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, owner, np.bincount(owner, minlength=len(texts))


def fingerprints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash per text that depends on its set of shingles only; 0 for an empty set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _M3), dtype=np.uint64)))
    ends = np.cumsum(counts)
    return mixed(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))

"""Sets of hashed five-word shingles, one for each text.

Texts are lower-cased (A-Z) and cut at blanks. Fewer than five words make one shingle of the
whole sequence; no words make the empty set. Shingles are 64-bit hashes: two different shingles
of a pair of texts meet with a chance of about (words of both)^2 / 2^64, which is the only way
in which an "exact" comparison here could err.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from notelake.llm.words import Slice, mix, slices

WORDS = 5


@dataclass
class Sets:
    """Sorted distinct shingles of rows ``first ..``; ``at`` has ``rows + 1`` offsets."""

    first: int
    at: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def row(self, i: int) -> np.ndarray:
        return self.values[self.at[i] : self.at[i + 1]]

    def fingerprints(self, seed: int = 0) -> np.ndarray:
        """A hash of each whole set, another one for each seed."""
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values, 1000 + 2 * seed), dtype=np.uint64)])
            return mix((total[self.at[1:]] - total[self.at[:-1]]) + self.sizes().astype(np.uint64), 1001 + 2 * seed)

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


def _sequence(h: np.ndarray) -> np.ndarray:
    key = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for x in h:
            key = mix(key * np.uint64(3) + x, 12)
        return mix(key + np.uint64(len(h)), 13)


def of_slice(s: Slice) -> Sets:
    h, counts = s.hashes(), s.counts()
    row = np.repeat(np.arange(s.rows), counts)
    n = len(h) - WORDS + 1
    if n > 0:
        with np.errstate(over="ignore"):
            key = h[:n].copy()
            for j in range(1, WORDS):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + h[j : n + j], 11)
        whole = row[:n] == row[WORDS - 1 :]
        key, owner = key[whole], row[:n][whole]
    else:
        key, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        extra = np.concatenate([_sequence(h[s.row_words[i] : s.row_words[i + 1]]) for i in short])
        key, owner = np.concatenate([key, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
    at = np.searchsorted(owner, np.arange(s.rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            key[a:b].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return Sets(s.first, np.searchsorted(owner[fresh], np.arange(s.rows + 1)), key[fresh])


def of_column(column: pa.Array) -> Iterator[Sets]:
    for s in slices(column):
        yield of_slice(s)


def of_text(text: str | None) -> np.ndarray:
    return next(of_column(pa.array([text or ""], pa.large_string()))).values


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())

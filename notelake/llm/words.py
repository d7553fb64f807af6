"""Vectorised tokenising of Arrow string columns.

A word is a run of bytes outside a separator set of ASCII bytes. All work is on UTF-8 bytes of
a slice of documents at a time, so memory follows ``SLICE_BYTES`` and the longest single text,
not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenised at once.
SLICE_BYTES = 1 << 20
#: Separators of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): one bijection for each seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 7)


@dataclass
class Slice:
    """Words of rows ``first .. first + rows - 1`` of a batch.

    ``data`` are the bytes and ``inside`` says which belong to words; ``begin``/``end`` the byte span of each word; ``row_words`` has
    ``rows + 1`` offsets into the words and ``row_bytes`` ``rows + 1`` offsets into ``data``.
    """

    first: int
    rows: int
    data: np.ndarray
    row_bytes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row_words: np.ndarray
    inside: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row_words)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word (polynomial, then mixed)."""
        if not len(self.begin):
            return np.empty(0, np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(self.data) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=total[1:])
            h = (total[self.end] - total[self.begin]) * down[self.begin]
        return mix(h + (self.end - self.begin).astype(np.uint64), 3)


def _table(separators: bytes) -> np.ndarray:
    lut = np.ones(256, bool)
    lut[list(separators)] = False
    return lut


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return offsets, data


def slices(column: pa.Array, lower: bool = True, separators: bytes = BLANKS) -> Iterator[Slice]:
    """Cuts a column into slices of whole rows of at most ``SLICE_BYTES`` (or one row)."""
    offsets, data = text_bytes(column)
    n, first, lut = len(offsets) - 1, 0, _table(separators)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        row_bytes = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = _LOWER[part]
        inside = lut[part]
        cut = np.ones(len(part) + 1, bool)  # a row starts, or a separator precedes
        cut[1:-1] = ~inside[:-1]
        cut[row_bytes] = True
        begin = np.flatnonzero(inside & cut[:-1])
        cut[:-1] |= ~inside  # now also: a separator follows
        end = np.flatnonzero(inside & cut[1:]) + 1
        row_words = np.searchsorted(begin, row_bytes)
        yield Slice(first, last - first, part, row_bytes, begin, end, row_words, inside)
        first = last


def row_sums(flags: np.ndarray, row_bytes: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one for each byte) over each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[row_bytes[1:]] - total[row_bytes[:-1]]

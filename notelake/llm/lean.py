"""Arrow steps whose Python workers give back the memory that they no longer use.

A worker is kept for later tasks. What its batches and arrays took stays with the allocators of
Arrow and C after they are gone, until these are told to release it; so an idle worker would hold
about as much as its largest step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives unused memory back to the system; where C's library has no ``malloc_trim``, Arrow's only."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b
        del b
        release()


def lean(run: Run) -> Run:
    """``run`` for ``mapInArrow``; unused memory is released after each batch and at the end."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_released(batches))
        finally:
            release()

    return through

from __future__ import annotations

import ctypes
import io
import re
from pathlib import Path

import pyarrow as pa
import pytest

from notelake.llm import ngram_join, quality_forest


class Steps:
    """In the place of a table: keeps the function that a step gives to ``mapInArrow``."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def batches(n: int, rows: int):
    """Batches of different words, read from a stream as a worker reads them."""
    for k in range(n):
        words = [" ".join(f"{k}w{i}x{j}" for j in range(250)) for i in range(rows)]
        sink = pa.BufferOutputStream()
        b = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(words)], names=["doc_id", "text"])
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        del b, words
        yield from pa.ipc.open_stream(io.BytesIO(sink.getvalue().to_pybytes()))


def held() -> int:
    """MB of this process that aren't mapped from files."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


@pytest.mark.parametrize("step", [quality_forest.rule_statistics, ngram_join.marked])
def test_a_worker_gives_back_what_its_batches_took(spark, step):
    run = step(Steps()).run
    for _ in run(batches(1, 100)):  # what any run keeps
        pass
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before = held()
    assert sum(len(b) for b in run(batches(2, 8000))) >= 16_000
    assert held() - before < 25

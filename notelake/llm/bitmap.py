"""A bitmap of hashes: which rows could be in a table, told without a shuffle of the rows.

It has 2 ** BITS bits (8 MB) whatever the table's size, so it can be broadcast; in a very large
table most bits are set and more rows take the way of those that could be in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.lean import lean

BITS, CHUNK = 26, 20


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits for the only column (long) of a table, gathered in chunks of 2 ** CHUNK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy() & (2**BITS - 1)
            for chunk in np.unique(at >> CHUNK).tolist():
                bits = held.setdefault(chunk, np.zeros(1 << CHUNK, bool))
                bits[at[at >> CHUNK == chunk] & (2**CHUNK - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    chunk = F.shiftright(F.col(hashes.columns[0]).bitwiseAND(F.lit(2**BITS - 1)), CHUNK)
    rows = hashes.repartition(1 << (BITS - CHUNK), chunk).mapInArrow(lean(run), "chunk int, bits binary").collect()
    out = np.zeros((1 << (BITS - CHUNK), 1 << (CHUNK - 3)), np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (2**BITS - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

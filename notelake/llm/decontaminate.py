"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are split by the size of their shingle set into classes of powers of two. An item's
sketch is its bottom-k MinHash under one global hash; k is the smallest length for which a
document that contains 75 % of the item must hold a sketch value (``n - ceil(0.75 n) + 1``), so
the search has recall 1 however long the document and however short the item are; banded
signatures of whole documents can't promise that at Jaccard values of one in a thousand. Each
class has its own cut: document shingles whose hash is beyond the largest sketch value of the
class can't be candidates and are dropped before the lookup. Candidates are verified by the
exact count of shared shingles over the document's whole set.

The index of the items goes to the executors in blocks of at most ``BLOCK_SHINGLES`` shingles
(a bound in bytes, checked while it is filled); a benchmark beyond one block is searched in as
many passes. Documents are never shuffled.

Edge cases: null, empty or blank items and texts have the empty set: such items match nothing,
such documents contain nothing; items of under five words are one shingle of all their words;
repeated items and rows are reported one by one; ids may be null; empty tables give empty
results. Further columns are ignored by ``contained_items`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.lean import lean
from notelake.llm.shingles import of_column, overlap
from notelake.llm.words import mix
from notelake.storage import table

#: An item is inside a document that holds this percentage of its shingles.
PERCENT = 75
#: Shingles of items in one broadcast block (8 bytes each, and up to 30 % more for sketches).
BLOCK_SHINGLES = 2_000_000
HASH_SEED = 51


@dataclass
class SizeClass:
    """Items of one size class: ``value``/``owner`` are all sketch entries sorted by value."""

    cut: np.uint64
    value: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    ids: list[int | None]
    sets: list[np.ndarray]
    classes: list[SizeClass]

    @classmethod
    def build(cls, items: list[tuple[int | None, np.ndarray]]) -> Index:
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, (_, tokens) in enumerate(items):
            n = len(tokens)
            if n:
                sketch = np.sort(mix(tokens, HASH_SEED))[: n - -(-PERCENT * n // 100) + 1]
                by.setdefault(n.bit_length(), []).append((sketch, np.full(len(sketch), i)))
        classes = []
        for size in sorted(by):
            value, owner = (np.concatenate(x) for x in zip(*by[size], strict=True))
            order = np.argsort(value, kind="stable")
            classes.append(SizeClass(value.max(), value[order], owner[order]))
        return cls([i for i, _ in items], [t for _, t in items], classes)

    def candidates(self, tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Pairs (row, item) that share a sketch value; ``row`` owns each of ``tokens``."""
        h, found = mix(tokens, HASH_SEED), []
        for c in self.classes:
            near = np.flatnonzero(h <= c.cut)
            lo = np.searchsorted(c.value, h[near], "left")
            hit = (lo < len(c.value)) & (c.value[np.minimum(lo, len(c.value) - 1)] == h[near])
            near, lo = near[hit], lo[hit]
            many = np.searchsorted(c.value, h[near], "right") - lo
            at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.stack([np.repeat(row[near], many), c.owner[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the items that rows of a column contain."""
        for s in of_column(column):
            row = np.repeat(np.arange(len(s)), s.sizes())
            for r, i in self.candidates(s.values, row).tolist():
                shared = overlap(self.sets[i], s.row(r))
                if 100 * shared >= PERCENT * len(self.sets[i]):
                    yield s.first + r, i, shared


def item_blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most ``BLOCK_SHINGLES`` shingles (or one item); one at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.row(i).view(np.int64) for s in of_column(b.column(1)) for i in range(len(s))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "tokens"])

    held, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(lean(run), "item_id long, tokens array<long>")
    for r in rows.toLocalIterator():
        tokens = np.array(r["tokens"], np.int64).view(np.uint64)
        if held and size + len(tokens) > BLOCK_SHINGLES:
            yield Index.build(held)
            held, size = [], 0
        held.append((r["item_id"], tokens))
        size += len(tokens)
    if held:
        yield Index.build(held)


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) for each document and item inside it."""
    ddl = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    found = None
    for index in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                hits = list(index.search(b.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())), *(pa.array(x, pa.int64()) for x in ([index.ids[i] for _, i, _ in hits], [len(index.sets[i]) for _, i, _ in hits], [n for _, _, n in hits]))],
                    names=["doc_id", "item_id", "item_shingles", "shared_shingles"],
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), ddl)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], ddl) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that contain no item."""
    for index in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[r for r, _, _ in shared.value.search(b.column(b.schema.get_field_index("text")))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def words_sql(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate({column}, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+')"


def shingle_sql(words: str) -> str:
    """DuckDB list of the distinct shingles of a list of words."""
    return f"list_distinct(CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i+4], ' ')) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END)"


OP3_SQL = f"""
WITH i AS MATERIALIZED (SELECT item_id, row_number() OVER () AS u, {words_sql('text')} AS w FROM benchmark),
s AS MATERIALIZED (SELECT item_id, u, {shingle_sql('w')} AS sh FROM i),
e AS MATERIALIZED (SELECT item_id, u, len(sh) AS n, unnest(sh) AS t FROM s),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {words_sql('text')} AS w FROM documents),
x AS (SELECT doc_id, r, unnest({shingle_sql('w')}) AS t FROM d),
m AS (SELECT doc_id, r, item_id, u, n, count(*) AS shared FROM x JOIN e USING (t) GROUP BY ALL)
SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(n AS BIGINT) AS item_shingles, CAST(shared AS BIGINT) AS shared_shingles
FROM m WHERE 100 * shared >= {PERCENT} * n
"""

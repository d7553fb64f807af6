"""Vector search: scoring, top k, MaxSim, link blending, grouping by note.

Two physical forms of scoring: JVM expressions for a handful of query vectors, and
``matmul_top_k`` for many, which multiplies Arrow batches by a block of queries and keeps only
each task's best k of each query, so that what is shuffled doesn't follow the corpus.
All orders are total: score descending, then note id, then line.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from notelake.functions import vector as V
from notelake.operators.index import exclusion_reason

#: Query vectors that are held on the executors at once.
QUERY_BLOCK = 4096


def score(blocks: DataFrame, queries: DataFrame, *, quantized: bool = False) -> DataFrame:
    """Adds ``query_id`` and ``similarity`` for each block and query vector (query_id, q).

    ``queries`` is a stated, small set; for many use ``matmul_top_k`` or ``best_scores``.
    """
    n = queries.limit(QUERY_BLOCK + 1).count()
    if n > QUERY_BLOCK:
        raise ValueError(f"over {QUERY_BLOCK} query vectors: use matmul_top_k")
    measure = V.q8_cosine if quantized else V.cosine
    return blocks.crossJoin(F.broadcast(queries.select("query_id", "q"))).withColumn("similarity", measure("embedding", "q")).drop("q")


def _parts(queries: DataFrame) -> Iterator[list]:
    """Query rows, at most ``QUERY_BLOCK`` at a time; a single job where that is all."""
    first = queries.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        if first:
            yield first
        return
    rows = queries.toLocalIterator()
    while part := list(islice(rows, QUERY_BLOCK)):
        yield part


def _by_size(rows: list) -> dict[int, np.ndarray]:
    """Unit query vectors by their size; zero vectors stay zero."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["q"]), []).append(r["q"])
    made = {n: np.array(q, np.float64) for n, q in by.items() if n}
    return {n: q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) for n, q in made.items()}


def best_scores(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``similarity``: the best cosine of each block over any number of query vectors (q).

    Arrow batches are multiplied by ``QUERY_BLOCK`` queries at a time, one after the other in one
    pass over the blocks; no pair leaves a task. A vector of another size than a query's scores 0."""
    schema = StructType([*blocks.schema.fields, StructField("similarity", DoubleType())])
    at, out = blocks.columns.index("embedding"), None
    for part in _parts(queries.select("q").where("q is not null")):
        shared = blocks.sparkSession.sparkContext.broadcast(_by_size(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=out is None) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = np.asarray(b.column(at).value_lengths().fill_null(0))
                best = np.full(len(b), -np.inf) if first else b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).copy()
                for n, q in shared.value.items():
                    ok = np.flatnonzero(size == n)
                    s = np.zeros(len(b))
                    if len(ok):
                        x = b.column(at).take(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ok), -1)
                        norm = np.linalg.norm(x, axis=1)
                        s[ok] = np.divide((x @ q.T).max(axis=1), norm, out=np.zeros(len(ok)), where=norm > 0)
                    best = np.maximum(best, s)
                columns = b.columns if first else b.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best)], names=schema.names)

        out = (blocks if out is None else out).mapInArrow(run, schema)
    return blocks.withColumn("similarity", F.lit(None).cast("double")) if out is None else out


def hits(scored: DataFrame, *, min_similarity: float, min_length: int = 0, exclude: Column | None = None) -> DataFrame:
    """Finite scores that are high enough, of blocks that are long enough, of other notes."""
    kept = scored.where(V.finite(F.col("similarity")) & (F.col("similarity") >= min_similarity))
    if min_length:
        kept = kept.where(F.col("length") >= min_length)
    return kept if exclude is None else kept.where(~exclude)


def ranked(df: DataFrame, per: list[str] | None = None) -> DataFrame:
    order = [F.desc("similarity"), "note_id", "line"]
    return df.withColumn("rank", F.row_number().over((Window.partitionBy(*per) if per else Window.partitionBy()).orderBy(*order)))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """A heap per task, merged: TakeOrderedAndProject."""
    return df.orderBy(F.desc("similarity"), "note_id", "line").limit(k)


def candidate_limit(max_hits: int, *, grouped: bool = True, mobile: bool = False) -> int:
    """How many blocks to fetch for so many notes."""
    factor, low, high = (24, 320, 800) if mobile else (64, 1536, 8192)
    return min(max(factor * max_hits, low), high) * (1 if grouped else 4)


def maxsim(scored: DataFrame, *, floor: bool = False, per_query_limit: int | None = None) -> DataFrame:
    """Best similarity of each block over all query vectors."""
    if per_query_limit is not None:
        scored = ranked(scored, ["query_id"]).where(F.col("rank") <= per_query_limit)
    best = F.max("similarity")
    return scored.groupBy("note_id", "line").agg((F.greatest(F.lit(0.0), best) if floor else best).alias("similarity"))


def group_by_note(found: DataFrame, *, method: str = "max", limit: int | None = None) -> DataFrame:
    """(note_id, similarity, blocks): blocks by similarity; any method but ``avg`` means max.

    Of equal notes the one with the first ``place`` (of a reranking) comes first, if there is one."""
    measure = F.avg("similarity") if method == "avg" else F.max("similarity")
    blocks = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "line", "similarity")))
    place = F.min("place") if "place" in found.columns else F.lit(0)
    out = found.groupBy("note_id").agg(measure.alias("similarity"), place.alias("_place"), F.transform(blocks, lambda b: F.struct(b["line"].alias("line"), b["similarity"].alias("similarity"))).alias("blocks"))
    return (out if limit is None else out.orderBy(F.desc("similarity"), "_place", "note_id").limit(limit)).drop("_place")


def visible(grouped: DataFrame, notes: DataFrame, excluded_folders: DataFrame, limit: int, *, extra: int = 5) -> DataFrame:
    """The first ``limit`` grouped notes that aren't conflicts, deleted or in an excluded folder.

    Notes are looked up after the ranking, a few more than asked for; unknown notes stay."""
    top = grouped.orderBy(F.desc("similarity"), "note_id").limit(limit + extra)
    known = notes.join(F.broadcast(top.select("note_id")), "note_id", "left_semi")  # limit + extra ids
    none = known.select("note_id").limit(0)
    reasons = exclusion_reason(known, none, excluded_folders, check_deleted=True, check_tags=False).where("reason is not null").select("note_id")
    return top.join(reasons, "note_id", "left_anti").orderBy(F.desc("similarity"), "note_id").limit(limit)


def tag_examples(found: DataFrame, notes: DataFrame, tags: DataFrame) -> DataFrame:
    """(note_id, similarity, tags, example) of found notes that have tags: examples for a prompt."""
    held = tags.groupBy("note_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    rows = held.join(F.broadcast(found.select("note_id", "similarity")), "note_id").join(notes.select("note_id", "title"), "note_id", "left")  # a few found notes
    text = F.concat(F.lit('The note "'), F.coalesce("title", F.lit("Unknown")), F.lit('" has the keywords: '), F.array_join("tags", ", "), F.lit("."))
    return rows.select("note_id", "similarity", "tags", text.alias("example"))

def mean_vector(blocks: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, embedding): weighted mean of the vectors (of one size) of each key.

    Vectors are summed in each task before the shuffle; missing ones don't count."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = blocks.where("embedding is not null").select(*keys, w.alias("w"), array_to_vector(V.as_doubles("embedding")).alias("v"))
    return parts.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("w"))).alias("embedding"))


def linked_mean(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, other): mean vector of all blocks of the notes a query links to (query_id, note_id)."""
    return mean_vector(links.select("query_id", "note_id").distinct().join(blocks, "note_id"), ["query_id"]).withColumnRenamed("embedding", "other")


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as int8 and their scales, by the rules of ``q8_values`` and ``q8_scale``."""
    finite = np.isfinite(x)
    most = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(finite.all(axis=1) & (most > 0), most / 127.0, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        q = np.clip(np.floor(x * (1.0 / scale)[:, None] + 0.5), -127, 127)
    return np.where(finite, q, 0).astype(np.int8), scale


def quantised(blocks: DataFrame) -> DataFrame:
    """Blocks with ``q8`` (a byte an element) and ``scale`` in the place of ``embedding``: the form to
    keep for many searches. Missing vectors are empty."""
    at = blocks.columns.index("embedding")
    kept = [f for f in blocks.schema.fields if f.name != "embedding"]
    schema = StructType([*kept, StructField("q8", BinaryType()), StructField("scale", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(at).value_lengths().fill_null(0))
            out, scale = [b""] * len(b), np.ones(len(b))
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == n)
                x = b.column(at).take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, n)
                q, scale[rows] = _quantise(x)
                for i, r in enumerate(rows.tolist()):
                    out[r] = q[i].tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(out, pa.binary()), pa.array(scale)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def _vectors(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """The chosen rows of a column of vectors, or of their bytes, as a matrix."""
    taken = column.take(pa.array(rows))
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(taken.to_pylist()), np.int8).astype(np.float64).reshape(-1, n)
    return taken.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)


def _sizes(column: pa.Array) -> np.ndarray:
    lengths = column.value_lengths() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    return np.asarray(lengths.fill_null(0))


def matmul_top_k(blocks: DataFrame, queries: DataFrame, k: int, min_similarity: float = -1.0) -> DataFrame:
    """(query_id, note_id, line, similarity): the best k blocks of each query by cosine.

    Queries are taken in blocks of ``QUERY_BLOCK``; every pass scans the corpus once. Vectors of
    another size than the queries' score 0. Of ``quantised`` blocks the bytes are compared, and the
    queries are quantised, too.
    """
    stored = "q8" if "q8" in blocks.columns else "embedding"
    out = None
    for part in _parts(queries.select("query_id", "q")):
        ids = np.array([r["query_id"] for r in part], np.int64)
        q = np.array([r["q"] for r in part], np.float64)
        if stored == "q8":
            q = _quantise(q)[0].astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = blocks.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            held: list[np.ndarray] = []
            for b in batches:
                ok = np.flatnonzero(_sizes(b.column(2)) == q.shape[1])
                s = np.zeros((len(b), len(q)))
                if len(ok):
                    x = _vectors(b.column(2), ok, q.shape[1])
                    n = np.linalg.norm(x, axis=1)
                    s[ok] = np.divide(x @ q.T, n[:, None], out=np.zeros((len(ok), len(q))), where=n[:, None] > 0)
                note, line = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                s[~np.isfinite(s)] = -np.inf
                floor = np.full(s.shape[1], min_similarity)
                if len(s) > k:  # no more than the best k (and what equals the last of them) can count
                    floor = np.maximum(floor, np.partition(s, len(s) - k, axis=0)[len(s) - k])
                row, col = np.nonzero(np.isfinite(s) & (s >= floor))
                held.append(np.rec.fromarrays([col, -s[row, col], note[row], line[row]], names="q,s,note,line"))
                if sum(map(len, held)) > 1 << 20:
                    held = [best(held)]
            if held:
                x = best(held)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x.q]), pa.array(x.note), pa.array(x.line), pa.array(-x.s)], names=["query_id", "note_id", "line", "similarity"])

        def best(held: list[np.ndarray]) -> np.recarray:
            x = np.concatenate(held)
            x = x[np.lexsort((x["line"], x["note"], x["s"], x["q"]))]
            first = np.searchsorted(x["q"], x["q"], "left")
            return x[np.arange(len(x)) - first < k].view(np.recarray)

        made = blocks.select(F.col("note_id").cast("long"), F.col("line").cast("long"), stored).mapInArrow(run, "query_id long, note_id long, line long, similarity double")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return blocks.sparkSession.createDataFrame([], "query_id long, note_id long, line long, similarity double")
    return ranked(out, ["query_id"]).where(F.col("rank") <= k).drop("rank")


def precision_recall(truth: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """One row: precision, recall and the same at k of ranked blocks against ranked truth,
    mean rank difference and mean score error of what both have. Empty denominators give 1."""
    t = truth.select("note_id", "line", F.col("rank").alias("tr"), F.col("similarity").alias("ts"))
    f = found.select("note_id", "line", F.col("rank").alias("fr"), F.col("similarity").alias("fs"))
    both = t.join(f, ["note_id", "line"], "full_outer")
    count = lambda c: F.count(F.when(c, F.lit(1)))
    share = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    hit, isf, ist = F.col("tr").isNotNull() & F.col("fr").isNotNull(), F.col("fr").isNotNull(), F.col("tr").isNotNull()
    near = (F.col("tr") <= k) & (F.col("fr") <= k)
    return both.agg(
        share(count(hit), count(isf)).alias("precision"), share(count(hit), count(ist)).alias("recall"),
        share(count(near), count(F.col("fr") <= k)).alias("precision_at_k"), share(count(near), count(F.col("tr") <= k)).alias("recall_at_k"),
        F.coalesce(F.avg(F.abs(F.col("tr") - F.col("fr"))), F.lit(0.0)).alias("rank_difference"), F.coalesce(F.avg(F.abs(F.col("ts") - F.col("fs"))), F.lit(0.0)).alias("score_error"),
    )

"""Lexical ranking (BM25), reciprocal rank fusion, keyword reranking, query decomposition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.storage import Scratch, materialize

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(t: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(t if isinstance(t, Column) else F.col(t)), F.lit(TOKEN), F.lit(0))


def bm25(notes: DataFrame, query: str, limit: int = 1000) -> DataFrame:
    """(note_id, score, rank) of notes (note_id, body) for a query.

    All words must occur, or one of them after the prefix ``any:1``. The formula is this
    library's own: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75. Texts are read
    once: the counts of the query's words go to a table (a few numbers a note), which the facts and
    the scores are read from; only the best ``limit`` notes are ranked. It runs when it is called.
    """
    either = query.startswith("any:1 ")
    words = sorted(set(re.findall(r"\w+", query.removeprefix("any:1 ").lower())))
    counted = notes.select("note_id", tokens("body").alias("w"))

    def occurrences(t: str) -> Column:
        return F.size(F.filter("w", lambda x: x == F.lit(t)))

    counted = counted.select("note_id", F.size("w").alias("len"), *[occurrences(t).alias(f"tf{i}") for i, t in enumerate(words)])
    if not words:
        return notes.select("note_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    with Scratch(notes.sparkSession) as scratch:
        found = _best(scratch.write(counted, "bm25-counts"), words, either, limit)
        found = materialize(found, "bm25")
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "note_id")))


def _best(counted: DataFrame, words: list[str], either: bool, limit: int) -> DataFrame:
    """(note_id, score) of the best notes from counts (note_id, len, tf0, tf1, ...)."""
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words))])
    joined = counted.crossJoin(F.broadcast(facts))  # one row of facts
    parts = []
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(F.lit(1.0) + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("mean_len"))))
    present = [F.col(f"tf{i}") > 0 for i in range(len(words))]
    test, score = present[0], parts[0]
    for p, s in zip(present[1:], parts[1:], strict=True):
        test, score = (test | p) if either else (test & p), score + s
    return joined.where(test).select("note_id", score.alias("score")).orderBy(F.desc("score"), "note_id").limit(limit)


def keyword_chunks(pool: DataFrame, hit_notes: DataFrame) -> DataFrame:
    """All pool blocks of the hit notes (note_id, rank), by hit, then similarity; ``position`` from 0."""
    found = pool.join(hit_notes.select("note_id", F.col("rank").alias("hit")), "note_id")
    return found.withColumn("position", F.row_number().over(Window.orderBy("hit", F.desc("similarity"), "note_id", "line")) - 1)


def first_of_key(df: DataFrame, order: list[Column | str], key: tuple[str, ...] = ("note_id", "line")) -> DataFrame:
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")


def rrf(semantic: DataFrame, keyword: DataFrame, *, k: int = 1, weight: float = 0.3, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two lists (note_id, line, position from 0).

    A semantic place adds 1 / (k + position), a keyword place weight / (k + position). The keys
    are summed after a union: one shuffle, with partial sums, instead of a full outer join.
    """
    part = lambda df, w: df.select("note_id", "line", (F.lit(w) / (F.lit(k) + F.col("position"))).alias("part"))
    fused = part(semantic, 1.0).unionByName(part(keyword, float(weight))).groupBy("note_id", "line").agg(F.sum("part").alias("score"))
    return fused if limit is None else fused.orderBy(F.desc("score"), "note_id", "line").limit(limit)


def rerank(pool: DataFrame, keyword_hits: list[DataFrame], *, max_hits: int, weight: float = 0.3, k: int = 1, notes_per_term: int = 100) -> DataFrame:
    """Fuses the first ``max_hits`` of a ranked pool (note_id, line, similarity, position) with
    the chunks of the terms' notes; the rest of the pool follows in its order. Adds ``place``."""
    if weight <= 0 or not keyword_hits:
        return pool.withColumn("place", F.col("position"))
    chunks = None
    for i, found in enumerate(keyword_hits):
        part = keyword_chunks(pool.drop("position"), found.where(F.col("rank") <= notes_per_term)).withColumn("term", F.lit(i))
        chunks = part if chunks is None else chunks.unionByName(part)
    chunks = first_of_key(chunks, ["term", "position"])
    chunks = chunks.withColumn("position", F.row_number().over(Window.orderBy("term", "position")) - 1)
    fused = rrf(pool.where(F.col("position") < max_hits), chunks, k=k, weight=weight, limit=max_hits)
    fused = fused.withColumn("lead", F.row_number().over(Window.orderBy(F.desc("score"), "note_id", "line")) - 1)
    out = pool.join(F.broadcast(fused.select("note_id", "line", "lead")), ["note_id", "line"], "left")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("lead").asc_nulls_last(), "position")) - 1).drop("lead")


def leads(found: DataFrame, hit_notes: DataFrame, *, max_hits: int, weight: float = 0.3, k: int = 1, notes_per_term: int = 100) -> DataFrame:
    """(note_id, line, lead): the first ``max_hits`` places, from 0, that ``rerank`` gives with one list of
    hits to the blocks (note_id, line, similarity) of an unranked pool of any size.

    No sort holds the pool: its best ``max_hits`` are taken, and blocks of hits are numbered note by note."""
    order = [F.desc("similarity"), "note_id", "line"]
    best = found.orderBy(*order).limit(max_hits).withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    near = hit_notes.where(F.col("rank") <= notes_per_term).select("note_id", F.col("rank").alias("hit"))
    chunks = found.join(F.broadcast(near), "note_id")  # notes_per_term rows, as below
    sizes = chunks.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("hit", (F.sum("n").over(Window.orderBy("hit")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("hit").orderBy(*order)) - 1
    chunks = chunks.withColumn("inside", inside).join(F.broadcast(starts), "hit").withColumn("position", F.col("start") + F.col("inside"))
    fused = rrf(best, chunks, k=k, weight=weight, limit=max_hits)
    return fused.select("note_id", "line", (F.row_number().over(Window.orderBy(F.desc("score"), "note_id", "line")) - 1).alias("lead"))


def parse_decomposition(answer: Column | str) -> Column:
    """Lines ``SEARCH: ... | KEYWORDS: a, b`` (or NONE) to structs (search, keywords).

    A keyword of several words asks for any of them (``any:1``)."""
    answer = answer if isinstance(answer, Column) else F.col(answer)
    lines = F.filter(F.split(answer, r"\r?\n"), lambda x: x.rlike(r"(?i)SEARCH:"))

    def one(line: Column) -> Column:
        raw = F.regexp_extract(line, r"(?i)KEYWORDS:\s*(.*)$", 1)
        words = F.filter(F.transform(F.split(raw, ","), lambda w: F.trim(w)), lambda w: (w != "") & (F.upper(w) != "NONE"))
        return F.struct(F.trim(F.regexp_extract(line, r"(?i)SEARCH:\s*([^|]*)", 1)).alias("search"), F.transform(words, lambda w: F.when(w.contains(" "), F.concat(F.lit("any:1 "), w)).otherwise(w)).alias("keywords"))

    return F.transform(lines, one)

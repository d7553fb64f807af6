"""Chat retrieval as one lazy plan: scope, MaxSim over sub-queries, rerank, neighbours, context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators import lexical as L
from notelake.operators import rag as R
from notelake.operators import search as S


@dataclass(frozen=True)
class Retrieval:
    """Parameters; the defaults are those of a fresh installation."""

    max_hits: int = 10
    min_similarity: float = 0.5
    min_length: int = 100
    per_query_limit: int | None = None
    keyword_weight: float = 0.3
    keyword_k: int = 1
    before: int = 0
    after: int = 0
    budget: int = 2048
    scope: tuple = field(default=())


def scoped_pool(blocks: DataFrame, named: list | None = None, found: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Blocks of the notes that a chat names and of those its search found (note_id), and whether
    that restricts the pool; where neither gives a block, all blocks."""
    if not named and found is None:
        return blocks, False
    pool = blocks.where(F.col("note_id").isin(list(named))) if named else blocks.limit(0)
    if found is not None:
        more = blocks.join(found.select("note_id").distinct(), "note_id", "left_semi")
        pool = pool.unionByName(more.where(~F.col("note_id").isin(list(named))) if named else more)
    return (blocks, False) if pool.isEmpty() else (pool, True)


def retrieve(blocks: DataFrame, queries: DataFrame, *, hits: list[DataFrame] = (), searched: DataFrame | None = None, options: Retrieval = Retrieval()) -> DataFrame:
    """Blocks for a prompt: (…block columns, similarity, rank).

    ``queries`` (query_id, q) are the vectors of all sub-queries, ``hits`` one ranked list of
    notes for each keyword. A scope of note ids, or of notes that a search found (``searched``),
    restricts the pool and lifts the least similarity. Neighbours take the place of their best hit.
    """
    pool, scoped = scoped_pool(blocks, list(options.scope), searched)
    least = 0.0 if scoped else options.min_similarity
    scored = S.hits(S.score(pool, queries), min_similarity=least, min_length=options.min_length)
    best = S.top_k(S.maxsim(scored, per_query_limit=options.per_query_limit), S.candidate_limit(options.max_hits))
    ranked = S.ranked(best).withColumn("position", F.col("rank") - 1).drop("rank")
    placed = L.rerank(ranked, list(hits), max_hits=options.max_hits, weight=options.keyword_weight, k=options.keyword_k).where(F.col("place") < options.max_hits)
    if options.before or options.after:
        near = R.neighbours(blocks, placed, before=options.before, after=options.after)
    else:
        near = blocks.join(placed.select("note_id", "line"), ["note_id", "line"], "left_semi")
    own = placed.select("note_id", "line", "similarity", F.col("place").alias("own"))
    lead = placed.groupBy("note_id").agg(F.min("place").alias("lead"))
    out = near.join(own, ["note_id", "line"], "left").join(lead, "note_id")
    return out.withColumn("rank", F.coalesce("own", F.col("lead") + 0.5)).drop("own", "lead")


def chat_context(retrieved: DataFrame, *, keywords: str | None = None, options: Retrieval = Retrieval()) -> DataFrame:
    """One row (context, citations) from retrieved blocks with title, heading and text."""
    return R.context_text(R.context(retrieved, options.budget, keywords=keywords))

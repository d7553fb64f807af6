"""The query API: index status, search by text or by note, serialised results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.embed import DEFAULT, Conditioning, Embedder
from notelake.operators import lexical as L
from notelake.operators import search as S
from notelake.storage import materialize

VERSION = 1


class SearchError(ValueError):
    """``code`` is invalid_input, not_ready or search_failed."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def attach_text(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds ``text`` by offset where it lies inside the body."""
    inside = (F.col("body_idx") >= 0) & (F.col("body_idx") + F.col("length") <= F.length("body"))
    return blocks.join(notes.select("note_id", "body"), "note_id", "left").withColumn("text", F.when(inside, F.substring("body", F.col("body_idx") + 1, F.col("length")))).drop("body")


def serialise(grouped: DataFrame) -> DataFrame:
    """(note_id, json) of grouped results; a missing similarity is 0."""
    return grouped.select("note_id", F.to_json(F.struct(F.col("note_id").alias("id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "blocks")).alias("json"))


@dataclass
class NoteIndex:
    """Blocks (note_id, line, length, embedding, ...) and notes (note_id; title and body for keywords) of
    one model."""

    blocks: DataFrame
    notes: DataFrame
    model_id: str
    embedder: Embedder
    conditioning: Conditioning = DEFAULT
    ready: bool = True
    #: folders (folder_id) whose notes are never shown; then ``notes`` has folder_id, is_conflict, deleted_time
    excluded_folders: DataFrame | None = None
    keyword_weight: float = 0.3

    def status(self) -> dict:
        n = self.blocks.agg(F.countDistinct("note_id").alias("n"), F.count(F.lit(1)).alias("b")).first()
        return {"ok": True, "version": VERSION, "ready": self.ready, "modelId": self.model_id, "indexStats": {"noteCount": n["n"], "blockCount": n["b"]}}

    def search(self, query: str | None = None, note_id: str | int | None = None, *, limit: int = 10, min_similarity: float = 0.5, min_length: int = 100, method: str = "max", mean: bool = False) -> DataFrame:
        """Grouped notes; a note id goes first, the query is the fallback for a note without blocks.

        A note may have any number of blocks; ``mean`` asks with their mean vector instead of all."""
        if not (query or "").strip() and note_id is None:
            raise SearchError("invalid_input", "a query or a note id is needed")
        if not 1 <= limit <= 100 or not 0 <= min_similarity <= 1:
            raise SearchError("invalid_input", "limit or least similarity out of bounds")
        if not self.ready:
            raise SearchError("not_ready", "the index isn't ready")
        found = self._found(query, note_id, mean, min_similarity, min_length)
        if found is None:
            return S.group_by_note(self.blocks.limit(0).withColumn("similarity", F.lit(0.0)))
        found = self._reranked(found, query, note_id, limit)
        if self.excluded_folders is None:
            return S.group_by_note(found, method=method, limit=limit)
        return S.visible(S.group_by_note(found, method=method), self.notes, self.excluded_folders, limit)

    def _found(self, query: str | None, note_id: str | int | None, mean: bool, min_similarity: float, min_length: int) -> DataFrame | None:
        """Blocks of other notes that are near: to any block of the note, to the mean of its blocks, or
        to the query."""
        queries = None
        if note_id is not None:
            own = self.blocks.where(F.col("note_id") == note_id)
            if not own.isEmpty():
                queries = S.mean_vector(own, ["note_id"]).select(F.col("embedding").alias("q")) if mean else own.select(F.col("embedding").alias("q"))
        if queries is None and (query or "").strip():
            q = self.embedder.embed([self.conditioning.apply(query, "query")], "query")[0]
            queries = self.blocks.sparkSession.createDataFrame([([float(x) for x in q],)], "q array<double>")
        if queries is None:
            return None
        return S.hits(S.best_scores(self.blocks, queries), min_similarity=min_similarity, min_length=min_length, exclude=F.col("note_id") == note_id if note_id is not None else None)

    def _reranked(self, found: DataFrame, query: str | None, note_id: str | int | None, limit: int) -> DataFrame:
        """All found blocks; ``place`` orders them after keyword hits of the query, or of the note's title."""
        found = found.select("note_id", "line", "similarity")
        words = (query or "").strip()
        if not words and note_id is not None and "title" in self.notes.columns:
            words = next((r["title"] or "" for r in self.notes.where(F.col("note_id") == note_id).select("title").limit(1).collect()), "").strip()
        lead = F.lit(limit)
        if words and "body" in self.notes.columns and self.keyword_weight > 0:
            found = materialize(found, "found-blocks")  # it is read several times
            first = L.leads(found, L.bm25(self.notes, words), max_hits=limit, weight=self.keyword_weight)
            found = found.join(F.broadcast(first), ["note_id", "line"], "left")  # a row for each hit
            lead = F.coalesce("lead", lead)
        return found.withColumn("place", F.struct(lead.alias("lead"), (-F.col("similarity")).alias("o"))).drop("lead")

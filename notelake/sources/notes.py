"""Note tables: scans, tags, recognised text of attachments, the legacy star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES_DDL = "note_id string, title string, body string, folder_id string, markup_language int, is_conflict boolean, deleted_time long, user_updated_time timestamp"


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Notes from Parquet; only the wanted columns are read. Paging has no counterpart."""
    notes = spark.read.parquet(path)
    return notes.select(*columns) if columns else notes


def newest_first(notes: DataFrame, limit: int) -> DataFrame:
    return notes.orderBy(F.desc("user_updated_time"), "note_id").limit(limit)


def by_ids(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup of a set of ids (repeats don't matter)."""
    return notes.join(ids.select("note_id").distinct(), "note_id", "left_semi")


def all_tags(note_tags: DataFrame) -> DataFrame:
    return note_tags.select("tag").where("tag is not null").distinct()


def with_tags(note_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Ids of notes that have one of the tags (exact titles)."""
    return note_tags.where(F.col("tag").isin(tags)).select("note_id").distinct()


def append_recognised(notes: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds the recognised text of a note's attachments to its body, by resource id."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("resource_id", "ocr_text"))), lambda x: x["ocr_text"]), "\n\n")
    found = resources.where(F.trim(F.coalesce("ocr_text", F.lit(""))) != "").groupBy("note_id").agg(text.alias("_ocr"))
    return notes.join(found, "note_id", "left").withColumn("body", F.when(F.col("_ocr").isNull(), F.col("body")).otherwise(F.concat(F.coalesce("body", F.lit("")), F.lit("\n\n"), F.col("_ocr")))).drop("_ocr")


def legacy_blocks(embeddings: DataFrame, notes: DataFrame) -> DataFrame:
    """The legacy star (embeddings.note_idx -> notes.idx) as blocks."""
    return embeddings.join(notes.select(F.col("idx").alias("note_idx"), "note_id", "hash"), "note_idx").select("note_id", "hash", "line", "body_idx", "length", "level", "title", "embedding")

"""Corpus pipeline: reject, deduplicate, decontaminate, mask secrets, mix.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and
read again. All stages but the last return the columns of ``documents`` (further columns are kept).

Edge cases: null, empty and very short texts fail the base rule of the first stage and go, so later
stages see words in every text; very long texts are read whole by each stage; rows without an id
are kept or go like others, and of a group of near copies a row with an id stays before one without;
repeated rows are near copies of each other, so one stays; ties go to the lesser id, then to a hash
of the text; without labels the forest rejects nothing, without benchmark items nothing is
contaminated; empty documents give an empty mix. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelake.llm import decontaminate, mixing, ngram_join, quality_forest, secrets
from notelake.storage import Scratch, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality_forest.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(mixing.sizes(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
]

#: The isolation forest has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:  # each table replaces the one before
            docs = scratch.write(stage(spark, docs, sf_dir), "pipeline")
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")

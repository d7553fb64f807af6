"""Quantised vectors in shards: encoding, two-phase writes, epoch-checked reads."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import vector as V
from notelake.operators.catalog import cap_rows, shard_rows
from notelake.operators.index import current_epoch

META_DDL = "struct<title:string,headingLevel:int,bodyStart:int,bodyLength:int,lineNumber:int,headingPath:array<string>>"


def row_meta() -> Column:
    """Metadata of a block; the heading path is left out where it is the title alone."""
    path = F.when(F.col("path").eqNullSafe(F.array("title")), F.lit(None)).otherwise(F.col("path"))
    return F.struct(F.col("title"), F.col("level").cast("int").alias("headingLevel"), F.col("body_idx").cast("int").alias("bodyStart"), F.col("length").cast("int").alias("bodyLength"), F.col("line").cast("int").alias("lineNumber"), path.cast("array<string>").alias("headingPath"))


def shown_title() -> Column:
    """A block's title from its metadata, else the last part of its heading path."""
    return F.coalesce("meta.title", F.try_element_at("meta.headingPath", F.lit(-1)), F.lit(""))


def build(blocks: DataFrame, model_id: str, epoch: int, *, cap: int = 0) -> DataFrame:
    """One shard a note with the first blocks that fit: (note_id, model_id, shard_no, epoch,
    vectors_b64, scales_b64, meta)."""
    kept = cap_rows(blocks, shard_rows(F.size("embedding"), cap))
    kept = kept.select("note_id", "line", V.q8_values("embedding").alias("q"), V.q8_scale("embedding").cast("float").alias("scale"), row_meta().alias("m"))
    groups = kept.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("line", "q", "scale", "m"))).alias("rows"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, s = b.column(1).to_pylist(), b.column(2).to_pylist()
            vectors = [base64.b64encode(np.array(x, np.int8).tobytes()).decode() for x in q]
            scales = [base64.b64encode(np.array(x, "<f4").tobytes()).decode() for x in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.string()), pa.array(scales, pa.string()), b.column(3)], names=["note_id", "vectors_b64", "scales_b64", "meta"])

    flat = groups.select(F.col("note_id").cast("string"), F.expr("flatten(transform(rows, x -> x.q))").alias("q"), F.expr("transform(rows, x -> x.scale)").alias("s"), F.expr("transform(rows, x -> x.m)").cast(f"array<{META_DDL}>").alias("meta"))
    coded = flat.mapInArrow(encode, f"note_id string, vectors_b64 string, scales_b64 string, meta array<{META_DDL}>")
    return coded.select("note_id", F.lit(model_id).alias("model_id"), F.lit(0).alias("shard_no"), F.lit(epoch).alias("epoch"), "vectors_b64", "scales_b64", "meta")


def decode(shards: DataFrame) -> DataFrame:
    """Rows of shard 0: (note_id, model_id, row, q8, scale, meta). A shard that lacks a field is
    skipped; rows are as many as vectors and metadata both have; a scale of 0 counts as 1."""
    whole = shards.where("shard_no = 0 and epoch is not null and vectors_b64 is not null and scales_b64 is not null and meta is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for note, model, v, s, meta in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                values, scales = np.frombuffer(base64.b64decode(v), np.int8), np.frombuffer(base64.b64decode(s), "<f4")
                dim = len(values) // max(1, len(scales))
                for i in range(min(len(values) // dim if dim else 0, len(meta))):
                    out.append((note, model, i, values[i * dim : (i + 1) * dim].tolist(), float(scales[i]) or 1.0, meta[i]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.float32(), b.schema.field(4).type.value_type)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["note_id", "model_id", "row", "q8", "scale", "meta"])

    picked = whole.select(F.col("note_id").cast("string"), "model_id", "vectors_b64", "scales_b64", F.col("meta").cast(f"array<{META_DDL}>"))
    return picked.mapInArrow(run, f"note_id string, model_id string, row int, q8 array<int>, scale float, meta {META_DDL}")


def put(shards: DataFrame, meta: DataFrame, shard_path: str, meta_path: str) -> None:
    """Two phases: shards first, metadata last; readers join on the epoch, so a write that broke
    off between the two stays invisible, and one that is retried shows once."""
    shards.write.mode("append").partitionBy("model_id").parquet(shard_path)
    meta.write.mode("append").partitionBy("model_id").parquet(meta_path)


def read(spark: SparkSession, shard_path: str, meta_path: str, *, model_id: str, max_rows: int | None = None) -> DataFrame:
    meta = spark.read.parquet(meta_path).where(F.col("model_id") == model_id)
    newest = meta.groupBy("note_id", "model_id").agg(F.max("epoch").alias("epoch"))
    shards = spark.read.parquet(shard_path).where(F.col("model_id") == model_id)
    rows = decode(current_epoch(newest, shards).dropDuplicates(["note_id", "model_id", "shard_no", "epoch"]))
    rows = rows.withColumn("title", shown_title())
    return rows if max_rows is None else rows.limit(max_rows)

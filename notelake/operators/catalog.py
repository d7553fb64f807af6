"""Catalog of models: discovery, inventory, coverage, capacity, shard sizes, legacy checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BYTES, ROW_META_BYTES, BLOCK_META_BYTES, OVERHEAD = 500_000, 220, 68, 1.15
MAX_DIM, DESKTOP_BYTES, MOBILE_BYTES, WARN_PERCENT = 2048, 200 << 20, 100 << 20, 80


def base64_length(n: Column) -> Column:
    return (F.ceil(n / F.lit(3.0)) * 4).cast("long")


def shard_bytes(dim: Column, rows: Column) -> Column:
    return base64_length(rows * dim) + base64_length(rows * 4) + rows * ROW_META_BYTES


def shard_rows(dim: Column, cap: int = 0) -> Column:
    """Rows that fit in a shard (at least one); a cap of 0 means the default."""
    return F.greatest(F.lit(1), F.floor(F.lit(cap or SHARD_BYTES) / shard_bytes(dim, F.lit(1)))).cast("long")


def cap_rows(blocks: DataFrame, rows: Column) -> DataFrame:
    """The first rows of each note, by line, that a shard holds."""
    return blocks.withColumn("_n", F.row_number().over(Window.partitionBy("note_id").orderBy("line"))).where(F.col("_n") <= rows).drop("_n")


def cache_bytes(blocks: Column, dim: Column) -> Column:
    """Memory of a quantised cache; null for a size that can't be cached."""
    return F.when((dim > 0) & (dim <= MAX_DIM), F.ceil((blocks * dim + blocks * BLOCK_META_BYTES) * OVERHEAD).cast("long"))


def capacity(blocks: Column, dim: Column, *, desktop: bool = True) -> Column:
    """struct(bytes, percent, warn)."""
    n = cache_bytes(blocks, dim)
    percent = n * 100.0 / (DESKTOP_BYTES if desktop else MOBILE_BYTES)
    return F.struct(n.alias("bytes"), percent.alias("percent"), (percent >= WARN_PERCENT).alias("warn"))


def discover(meta: DataFrame) -> DataFrame:
    """(model_id, notes, dim, version) from (note_id, models: map); dim and version of the least note id."""
    rows = meta.select("note_id", F.explode("models").alias("model_id", "m"))
    first = F.min(F.struct("note_id", F.col("m.dim").alias("dim"), F.col("m.modelVersion").alias("version")))
    return rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("notes"), first.alias("f")).select("model_id", "notes", "f.dim", "f.version")


def put_model(models: Column, model_id: str, value: Column) -> Column:
    """Sets one model's entry of a map and keeps the others."""
    return F.map_concat(F.map_filter(models, lambda k, _: k != model_id), F.create_map(F.lit(model_id), value))


def drop_model(models: Column, model_id: str) -> Column:
    return F.map_filter(models, lambda k, _: k != model_id)


def delete_model(meta: DataFrame, model_id: str) -> DataFrame:
    """Metadata (note_id, models) without a model; notes without any other lose their row."""
    return meta.withColumn("models", drop_model(F.col("models"), model_id)).where(F.size("models") > 0)


def deletion_summary(meta: DataFrame, model_id: str) -> DataFrame:
    """One row: notes that keep other models, that lose their metadata, and that lack the model."""
    has, n = F.coalesce(F.map_contains_key("models", model_id), F.lit(False)), F.size("models")
    count = lambda c: F.count(F.when(c, 1))
    return meta.agg(count(has & (n > 1)).alias("updated"), count(has & (n == 1)).alias("removed"), count(~has).alias("skipped"))


def inventory(models: DataFrame, active: str | None) -> DataFrame:
    """Estimated bytes of each model (model_id, dim, rows, notes), by id."""
    size = shard_bytes(F.col("dim"), F.col("rows"))
    return models.select("model_id", "notes", "rows", size.alias("bytes"), F.col("model_id").eqNullSafe(F.lit(active)).alias("active"))


def metadata_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(model_id, changed): a side missing, dim, version or settings differ, or counts by 10 %."""
    o, n = old.alias("o"), new.alias("n")

    def far(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).when(a == 0, b != 0).otherwise(F.abs(b - a) / a >= 0.1)

    differs = F.lit(False)
    for c in ("dim", "version", "settings"):
        differs |= ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    missing = F.col("o.present").isNull() | F.col("n.present").isNull()
    joined = old.withColumn("present", F.lit(1)).alias("o").join(new.withColumn("present", F.lit(1)).alias("n"), "model_id", "full_outer")
    return joined.select("model_id", (missing | differs | far("rowCount") | far("noteCount")).alias("changed"))


def sample_ids(notes: DataFrame, size: int = 150, seed: int = 0) -> DataFrame:
    """A reproducible sample (100 to 200 ids): the least hashes instead of a reservoir."""
    return notes.select("note_id").orderBy(F.xxhash64("note_id", F.lit(seed)), "note_id").limit(min(max(size, 100), 200))


def coverage(sample: DataFrame, covered: DataFrame, total: int) -> DataFrame:
    """(sampled, hits, ratio, estimate, low): share of sampled notes with embeddings."""
    rows = sample.join(covered.select("note_id").distinct().withColumn("_c", F.lit(1)), "note_id", "left")
    n, hits = F.count(F.lit(1)), F.count("_c")
    ratio = F.when(n == 0, F.lit(1.0)).otherwise(hits / n)
    return rows.agg(n.alias("sampled"), hits.alias("hits"), ratio.alias("ratio"), F.floor(ratio * total + 0.5).cast("long").alias("estimate"), (ratio < 0.1).alias("low"))


def legacy_check(models: DataFrame, name: str, version: str, embedding_version: int, block_size: int) -> DataFrame:
    """(status) of a legacy store (model_name, model_version, max_block_size, embedding_version)."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    named = F.col("model_name") == name
    same = named & (F.col("embedding_version") == embedding_version)
    versioned = same & (F.col("model_version") == version)
    return models.agg(F.when(~any_(named), "new").when(~any_(same), "embedding_update").when(~any_(versioned), "model_update").when(~any_(versioned & (F.col("max_block_size") == block_size)), "size_change").otherwise("OK").alias("status"))


def migrate_legacy(models: DataFrame, default: int = 512) -> DataFrame:
    return models if "max_block_size" in models.columns else models.withColumn("max_block_size", F.lit(default))

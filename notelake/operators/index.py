"""Index maintenance: exclusions, change status, sweeps, upserts, garbage collection, epochs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far an incremental sweep reaches back behind the last one, for late changes.
LATE = timedelta(hours=12)


def exclusion_reason(notes: DataFrame, tagged: DataFrame, excluded_folders: DataFrame, *, check_deleted: bool = False, check_tags: bool = True) -> DataFrame:
    """Adds ``reason``: the first of conflict, folder, tag and deleted that holds, else null.

    ``tagged`` (note_id) are notes with an exclusion tag, ``excluded_folders`` (folder_id); blank
    folder ids exclude nothing.
    """
    tags = tagged.select("note_id").distinct().withColumn("_tag", F.lit(True))
    folders = excluded_folders.where(F.trim("folder_id") != "").select("folder_id").distinct().withColumn("_folder", F.lit(True))
    reason = F.when(F.coalesce("is_conflict", F.lit(False)), "conflict").when(F.col("_folder"), "folder")
    if check_tags:
        reason = reason.when(F.col("_tag"), "tag")
    if check_deleted:
        reason = reason.when(F.coalesce("deleted_time", F.lit(0)) > 0, "deleted")
    return notes.join(tags, "note_id", "left").join(folders, "folder_id", "left").withColumn("reason", reason).drop("_tag", "_folder")


def candidates(classified: DataFrame, current: str | int | None) -> DataFrame:
    """Ids of notes that aren't excluded, and the current note in any case."""
    keep = F.col("reason").isNull()
    if current is not None:
        keep |= F.col("note_id") == current
    return classified.where(keep).select("note_id").distinct()


def changed_since(notes: DataFrame, last: datetime) -> DataFrame:
    """Incremental sweep: a pushed-down filter on the change time, with a margin for late rows."""
    return notes.where(F.col("user_updated_time") > F.lit(last - LATE))


def choose_sweep(now: datetime, last: datetime | None, last_full: datetime | None, interval: timedelta) -> str:
    """``full`` if never or over 12 hours ago, else ``incremental`` if the interval has passed."""
    if not interval:
        return "none"
    if last_full is None or now - last_full > LATE:
        return "full"
    return "incremental" if last is None or now - last > interval else "none"


def diff_status(stored: DataFrame, current: DataFrame, *, force: bool = False) -> DataFrame:
    """(note_id, status) from stored (note_id, hash, meta_hash, settings, model_version, shard_ok,
    legacy) and current (note_id, hash, settings, model_version, reason) rows; first match wins."""
    s, c = stored.alias("s"), current.alias("c")
    both = s.join(c, "note_id", "full_outer")
    same = F.col("s.hash").eqNullSafe(F.col("c.hash")) & F.col("s.hash").isNotNull()
    legacy, shard = F.coalesce("s.legacy", F.lit(False)), F.coalesce("s.shard_ok", F.lit(False))
    meta = F.col("s.meta_hash").eqNullSafe(F.col("c.hash"))
    settings = F.col("s.settings").eqNullSafe(F.col("c.settings"))
    version = F.col("s.model_version").eqNullSafe(F.col("c.model_version"))
    status = F.when(F.col("c.reason").isNotNull(), F.when(F.col("c.reason") == "folder", "excluded_kept").otherwise("excluded"))
    status = status.when(F.col("c.hash").isNull(), "orphan")
    if force:
        status = status.when(same & meta & version & settings & shard, "unchanged").when(same & legacy, "backfill")
    else:
        status = status.when(same & F.col("s.meta_hash").isNull() & legacy, "backfill").when(same & (~meta | ~shard), "backfill")
        status = status.when(same & ~settings, "settings_mismatch").when(same, "unchanged")
    return both.select("note_id", status.otherwise("rebuild").alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest change of each key."""
    return changes.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def drop_orphans(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Blocks whose note exists and isn't deleted."""
    alive = notes.where(F.coalesce("deleted_time", F.lit(0)) == 0).select("note_id").distinct()
    return blocks.join(alive, "note_id", "left_semi")


def delete_notes(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    return blocks.join(ids.select("note_id").distinct(), "note_id", "left_anti")


def drop_excluded(blocks: DataFrame, status: DataFrame) -> DataFrame:
    """The clean-up after a sweep: blocks of excluded and orphaned notes go; those of excluded
    folders are kept (``excluded_kept``), so that a folder can come back."""
    return delete_notes(blocks, status.where(F.col("status").isin("excluded", "orphan")))


def drop_other_versions(shards: DataFrame, keep: DataFrame) -> DataFrame:
    """Shards of the kept (note_id, model_id, hash); other models or hashes of these notes go."""
    touched = keep.select("note_id").distinct()
    return shards.join(touched, "note_id", "left_anti").unionByName(shards.join(keep.select("note_id", "model_id", "hash").distinct(), ["note_id", "model_id", "hash"], "left_semi").select(shards.columns))


def current_epoch(meta: DataFrame, shards: DataFrame) -> DataFrame:
    """Shards that match their metadata's epoch: what a half-done write left isn't visible."""
    return shards.join(meta.select("note_id", "model_id", "epoch").distinct(), ["note_id", "model_id", "epoch"])


SETTINGS = ("embedTitle", "embedPath", "embedHeading", "embedTags", "includeCode", "minLength", "maxTokens")


def mismatches(stored: DataFrame, model: str, version: str, embedding_version: int, settings: dict) -> DataFrame:
    """(note_id, type, detail), one for each note and type, of metadata rows that don't fit."""
    changes = F.array(*[F.when(~F.col(f"settings.{k}").eqNullSafe(F.lit(v)), F.concat(F.lit(f"{k}: "), F.col(f"settings.{k}").cast("string"), F.lit(f" -> {str(v).lower()}"))) for k, v in settings.items()])
    changes = F.filter(changes, lambda x: x.isNotNull())
    one = lambda test, kind, detail: F.when(test, F.struct(F.lit(kind).alias("type"), detail.cast("string").alias("detail")))
    kinds = F.array(
        one(F.col("model_id") != model, "model", F.col("model_id")),
        one(F.col("model_version") != version, "model_version", F.col("model_version")),
        one(F.col("embedding_version") != embedding_version, "embedding_version", F.col("embedding_version")),
        one(F.size(changes) > 0, "settings", F.array_join(changes, ", ")),
    )
    found = stored.select("note_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("m")).select("note_id", "m.type", "m.detail")
    return found.groupBy("note_id", "type").agg(F.min("detail").alias("detail"))


def mismatch_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("notes"), F.array_join(F.sort_array(F.collect_set("detail")), "; ").alias("details"))


def update_totals(blocks: DataFrame) -> DataFrame:
    """One row: notes, rows and the dimension (0 without rows; the greatest if they differ)."""
    return blocks.agg(F.countDistinct("note_id").alias("notes"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("long").alias("dim"))


def update_summary(status: DataFrame) -> DataFrame:
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return status.agg(n("rebuild", "backfill").alias("success"), n("unchanged").alias("unchanged"), n("excluded", "excluded_kept", "settings_mismatch").alias("skipped"), n("failed").alias("failed"))


def folder_closure(folders: DataFrame, root: str, *, depth: int = 100) -> DataFrame:
    """(folder_id, depth) of a folder and all below it: a recursive query."""
    folders.createOrReplaceTempView("_notelake_folders")
    return folders.sparkSession.sql(
        "WITH RECURSIVE sub(folder_id, depth) MAX RECURSION LEVEL " + str(depth) + " AS ("
        "SELECT folder_id, 0 FROM _notelake_folders WHERE folder_id = :root UNION ALL "
        "SELECT f.folder_id, sub.depth + 1 FROM _notelake_folders f JOIN sub ON f.parent_id = sub.folder_id) SELECT folder_id, depth FROM sub",
        args={"root": root},
    )


def set_folders(excluded: DataFrame, folders: DataFrame, root: str, *, exclude: bool) -> DataFrame:
    """Adds a folder's subtree to the excluded folders, or takes it out."""
    sub = folder_closure(folders, root).select("folder_id")
    return excluded.select("folder_id").union(sub).distinct() if exclude else excluded.select("folder_id").join(sub, "folder_id", "left_anti")

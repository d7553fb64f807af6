"""Queries of index maintenance and the catalog. Notes are documents; tags come from labels."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import catalog as G
from notelake.operators import index as I
from notelake.plans.base import query
from notelake.sources import kv
from notelake.sources import notes as N
from notelake.storage import fresh_path, table
from notelake.streaming.changes import IndexTable, apply_changes

_N = "n AS (SELECT d.doc_id AS note_id, source AS folder_id, coalesce(quality = 0, FALSE) AS is_conflict, CASE WHEN d.doc_id % 13 = 0 THEN 1 ELSE 0 END AS deleted_time, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_REASON = "r AS (SELECT note_id, CASE WHEN is_conflict THEN 'conflict' WHEN folder_id = 'src3' THEN 'folder' WHEN toxic = 1 THEN 'tag' WHEN deleted_time > 0 THEN 'deleted' END AS reason FROM n)"


def classified(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("note_id"), "quality", "toxic")
    n = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("folder_id"), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0).alias("deleted_time"))
    n = n.join(labels.select("note_id", (F.col("quality") == 0).alias("is_conflict")), "note_id", "left")
    folders = spark.createDataFrame([("src3",), ("",)], "folder_id string")
    return I.exclusion_reason(n, labels.where("toxic = 1"), folders, check_deleted=True)


@query(f"WITH {_N}, {_REASON} SELECT * FROM r")
def exclusion_reason(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("note_id", "reason")


@query(f"WITH {_N}, {_REASON} SELECT DISTINCT note_id FROM r WHERE reason IS NULL OR note_id = 13")
def candidate_set(spark: SparkSession, d: str) -> DataFrame:
    return I.candidates(classified(spark, d), 13)


@query("SELECT event_id, user_id AS note_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 12 HOURS")
def incremental_cutoff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("note_id"), F.col("ts").alias("user_updated_time"))
    return I.changed_since(e, datetime(2024, 1, 20)).select("event_id", "note_id")


@query("SELECT unnest(['full', 'full', 'incremental', 'none', 'incremental']) AS sweep, unnest(range(0, 5)) AS id")
def sweep_choice(spark: SparkSession, d: str) -> DataFrame:
    now, m = datetime(2024, 1, 2), timedelta(minutes=1)
    cases = [(None, None), (now - m, now - timedelta(hours=13)), (now - 11 * m, now - timedelta(hours=1)), (now - 9 * m, now - timedelta(hours=1)), (None, now - timedelta(hours=1))]
    return spark.createDataFrame([(i, I.choose_sweep(now, a, b, 10 * m)) for i, (a, b) in enumerate(cases)], "id long, sweep string")


@query(
    """WITH s AS (SELECT doc_id, md5(text) AS hash, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'old' ELSE md5(text) END AS meta, CASE WHEN doc_id % 10 = 2 THEN 'b' ELSE 'a' END AS settings, doc_id % 10 <> 3 AS shard, doc_id % 20 = 0 AS legacy FROM documents WHERE doc_id % 7 <> 6),
c AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 4 THEN text || '!' ELSE text END) AS hash, CASE doc_id % 30 WHEN 5 THEN 'folder' WHEN 7 THEN 'tag' END AS reason FROM documents WHERE doc_id % 11 <> 10)
SELECT doc_id AS note_id, CASE WHEN c.reason = 'folder' THEN 'excluded_kept' WHEN c.reason IS NOT NULL THEN 'excluded' WHEN c.hash IS NULL THEN 'orphan'
 WHEN s.hash = c.hash AND s.meta IS NULL AND s.legacy THEN 'backfill' WHEN s.hash = c.hash AND (s.meta IS DISTINCT FROM c.hash OR NOT s.shard) THEN 'backfill'
 WHEN s.hash = c.hash AND s.settings <> 'a' THEN 'settings_mismatch' WHEN s.hash = c.hash THEN 'unchanged' ELSE 'rebuild' END AS status FROM s FULL JOIN c USING (doc_id)"""
)
def sweep_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i, h = F.col("doc_id"), F.md5("text")
    stored = docs.where("doc_id % 7 <> 6").select(i.alias("note_id"), h.alias("hash"), F.when(i % 10 == 1, "old").when(i % 10 != 0, h).alias("meta_hash"), F.when(i % 10 == 2, "b").otherwise("a").alias("settings"), F.lit("1").alias("model_version"), (i % 10 != 3).alias("shard_ok"), (i % 20 == 0).alias("legacy"))
    current = docs.where("doc_id % 11 <> 10").select(i.alias("note_id"), F.md5(F.when(i % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"), F.lit("a").alias("settings"), F.lit("1").alias("model_version"), F.when(i % 30 == 5, "folder").when(i % 30 == 7, "tag").alias("reason"))
    return I.diff_status(stored, current)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") % 300).alias("note_id"), F.col("vec_id").alias("line"))


@query("SELECT vec_id % 300 AS note_id, vec_id AS line FROM embeddings WHERE vec_id % 300 IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0)")
def orphan_gc(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), (F.col("doc_id") % 13 == 0).cast("int").alias("deleted_time"))
    return I.drop_orphans(_blocks(spark, d), n)


@query("SELECT vec_id % 300 AS note_id, vec_id AS line FROM embeddings WHERE vec_id % 300 NOT IN (SELECT item_id FROM benchmark)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    return I.delete_notes(_blocks(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("note_id")))


@query("SELECT label AS note_id, vec_id AS shard FROM embeddings WHERE vec_id % 3 = label % 3")
def epoch_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    shards = e.select(F.col("label").alias("note_id"), F.lit("m").alias("model_id"), (F.col("vec_id") % 3).alias("epoch"), F.col("vec_id").alias("shard"))
    meta = e.select(F.col("label").alias("note_id"), F.lit("m").alias("model_id"), (F.col("label") % 3).cast("long").alias("epoch"))
    return I.current_epoch(meta, shards).select("note_id", "shard")


@query("SELECT CAST(vec_id % 50 AS VARCHAR) AS note_id, vec_id AS shard FROM embeddings WHERE vec_id % 50 >= 25 OR (vec_id % 2 = 0 AND vec_id % 3 = 1)")
def drop_old_versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    shards = e.select((F.col("vec_id") % 50).cast("string").alias("note_id"), (F.col("vec_id") % 2).cast("string").alias("model_id"), (F.col("vec_id") % 3).cast("string").alias("hash"), F.col("vec_id").alias("shard"))
    keep = shards.where("cast(note_id as int) < 25").select("note_id", F.lit("0").alias("model_id"), F.lit("1").alias("hash"))
    return I.drop_other_versions(shards, keep).select("note_id", "shard")


@query("SELECT user_id AS note_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The stream of changes, drained into a versioned table: the same as one batch over all."""
    schema = "note_id long, event_id long, ts timestamp"
    at = fresh_path(spark, "changes")
    table(spark, d, "events").select(F.col("user_id").alias("note_id"), "event_id", "ts").orderBy("ts", "event_id").write.parquet(f"{at}/in")
    index = IndexTable(spark, f"{at}/index", schema, ["note_id"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    keep = lambda rows: I.latest(rows.unionByName(index.read()), ["note_id"], [F.desc("ts"), F.desc("event_id")])
    apply_changes(stream, index, f"{at}/checkpoint", process=keep, time="ts").awaitTermination()
    return index.read()


@query("SELECT doc_id AS note_id, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.upsert(docs.select(F.col("doc_id").alias("note_id"), F.md5("text").alias("hash")), docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("note_id"), F.lit("new").alias("hash")), ["note_id"])


_SETTINGS = {"embedTitle": True, "embedPath": True, "embedHeading": True, "embedTags": True, "includeCode": False, "minLength": 100, "maxTokens": 512}


def _meta(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    settings = F.struct(*[(i % 4 != 1).alias(k) if k == "embedTags" else (F.when(i % 6 == 2, 256).otherwise(512)).alias(k) if k == "maxTokens" else F.lit(v).alias(k) for k, v in _SETTINGS.items()])
    return table(spark, d, "documents").select(i.alias("note_id"), F.when(i % 9 == 4, "other").otherwise("m").alias("model_id"), F.when(i % 10 == 3, "0").otherwise("1").alias("model_version"), F.lit(3).alias("embedding_version"), settings.alias("settings"))


_MISMATCH = """m AS (SELECT doc_id AS note_id, 'model' AS type, 'other' AS detail FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT doc_id, 'model_version', '0' FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT doc_id, 'settings', array_to_string(list_filter([CASE WHEN doc_id % 4 = 1 THEN 'embedTags: false -> true' END, CASE WHEN doc_id % 6 = 2 THEN 'maxTokens: 256 -> 512' END], lambda x: x IS NOT NULL), ', ') FROM documents WHERE doc_id % 4 = 1 OR doc_id % 6 = 2)"""


@query(f"WITH {_MISMATCH} SELECT * FROM m")
def settings_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return I.mismatches(_meta(spark, d), "m", "1", 3, _SETTINGS)


@query(f"WITH {_MISMATCH} SELECT type, count(*) AS notes, string_agg(DISTINCT detail, '; ' ORDER BY detail) AS details FROM m GROUP BY type")
def mismatch_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.mismatch_summary(I.mismatches(_meta(spark, d), "m", "1", 3, _SETTINGS))


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS success, count(*) FILTER (doc_id % 3 = 1) AS unchanged, count(*) FILTER (doc_id % 3 = 2) AS skipped, count(*) FILTER (FALSE) AS failed FROM documents")
def update_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("rebuild"), F.lit("unchanged"), F.lit("excluded")), (F.col("doc_id") % 3 + 1).cast("int"))
    return I.update_summary(table(spark, d, "documents").select(status.alias("status")))


def _store(spark: SparkSession, d: str) -> DataFrame:
    """Metadata JSON of documents in a key-value table; every 17th is malformed."""
    i = F.col("doc_id")
    models = F.concat(F.lit('{"models":{"m1":{"dim":64,"modelVersion":"1","epoch":'), (i % 3).cast("string"), F.lit('}'), F.when(i % 2 == 0, ',"m2":{"dim":128,"modelVersion":"b","epoch":1}').otherwise(""), F.lit("}}"))
    return table(spark, d, "documents").select(i.alias("note_id"), F.lit("meta").alias("key"), F.when(i % 17 == 0, "{oops").otherwise(models).alias("value"))


@query("SELECT doc_id AS note_id, doc_id % 3 AS epoch, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS models FROM documents WHERE doc_id % 17 <> 0")
def userdata_json(spark: SparkSession, d: str) -> DataFrame:
    m = kv.note_meta(_store(spark, d))
    return m.select("note_id", F.col("models")["m1"]["epoch"].cast("long").alias("epoch"), F.size("models").alias("models"))


@query("SELECT model_id, notes, dim, version FROM (SELECT 'm1' AS model_id, count(*) AS notes, 64 AS dim, '1' AS version FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT 'm2', count(*), 128, 'b' FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 2 = 0)")
def model_discovery(spark: SparkSession, d: str) -> DataFrame:
    return G.discover(kv.note_meta(_store(spark, d)))


@query("SELECT doc_id AS note_id, CASE WHEN doc_id % 2 = 0 THEN 'm2,m3' ELSE 'm3' END AS kept FROM documents WHERE doc_id % 17 <> 0")
def model_map_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = kv.note_meta(_store(spark, d))
    changed = G.drop_model(G.put_model(F.col("models"), "m3", F.col("models")["m1"]), "m1")
    return m.select("note_id", F.array_join(F.array_sort(F.map_keys(changed)), ",").alias("kept"))


@query("SELECT note_id, key, value FROM (SELECT doc_id AS note_id, 'k' AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS value FROM documents) WHERE note_id % 4 <> 1")
def kv_put_delete(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.lit("k").alias("key"), F.col("source").alias("value"))
    return kv.delete(kv.put(s, s.where("note_id % 3 = 0").withColumn("value", F.lit("new"))), s.where("note_id % 4 = 1"))


@query("SELECT lang AS model_id, count(*) AS notes, sum(n_chars // 100) :: BIGINT AS rows, (sum(n_chars // 100) * 220 + 4 * ceil(sum(n_chars // 100) * 64 / 3.0e0) + 4 * ceil(sum(n_chars // 100) * 4 / 3.0e0)) :: BIGINT AS bytes, lang = 'en' AS active FROM documents GROUP BY lang")
def model_inventory(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").groupBy(F.col("lang").alias("model_id")).agg(F.count(F.lit(1)).alias("notes"), F.sum(F.floor(F.col("n_chars") / 100)).alias("rows"), F.lit(64).alias("dim"))
    return G.inventory(m, "en")


@query("SELECT CAST(doc_id AS VARCHAR) AS model_id, doc_id % 5 = 0 OR doc_id % 7 = 0 OR (doc_id % 3 = 0 AND doc_id > 0) AS changed FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0")
def metadata_changed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("doc_id % 5 <> 0 or doc_id % 2 = 0")
    cols = lambda dim, rows: (i.cast("string").alias("model_id"), dim.alias("dim"), F.lit("1").alias("version"), F.lit("s").alias("settings"), rows.alias("rowCount"), F.lit(10).alias("noteCount"))
    old = docs.select(*cols(F.lit(64), F.lit(100)))
    new = docs.where("doc_id % 5 <> 0").select(*cols(F.when(i % 7 == 0, 32).otherwise(64), F.when((i % 3 == 0), 115).otherwise(109)))
    return G.metadata_changed(old, new)


@query("WITH s AS (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 150), x AS (SELECT count(*) AS n, count(l.doc_id) AS h FROM s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT n AS sampled, h AS hits, round(h / n, 6) AS ratio, CAST(floor(h / n * (SELECT count(*) FROM documents) + 0.5e0) AS BIGINT) AS estimate, h / n < 0.1 AS low FROM x")
def coverage_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"))
    sample = n.orderBy(F.md5(F.col("note_id").cast("string")), "note_id").limit(150)
    c = G.coverage(sample, table(spark, d, "labels").select(F.col("doc_id").alias("note_id")), n.count())
    return c.withColumn("ratio", F.round("ratio", 6))


@query()
def note_sample(spark: SparkSession, d: str) -> DataFrame:
    return G.sample_ids(table(spark, d, "documents").select(F.col("doc_id").alias("note_id")), 150)


@query("SELECT unnest(['new', 'embedding_update', 'model_update', 'size_change', 'OK']) AS status, unnest(['x', 'e', 'v', 's', 'm']) AS model")
def legacy_model_check(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.createDataFrame([("e", "1", 512, 2), ("v", "0", 512, 3), ("s", "1", 256, 3), ("m", "1", 512, 3)], "model_name string, model_version string, max_block_size int, embedding_version int")
    parts = [G.legacy_check(stored, m, "1", 3, 512).withColumn("model", F.lit(m)) for m in "xevsm"]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("SELECT l.doc_id AS note_id, CAST(v.vec_id AS BIGINT) AS line, md5(CAST(l.doc_id AS VARCHAR)) AS hash FROM embeddings v JOIN documents l ON v.vec_id % 50 = l.doc_id")
def legacy_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("note_idx"), F.col("vec_id").alias("line"), F.lit(0).alias("body_idx"), F.lit(1).alias("length"), F.lit(0).alias("level"), F.lit("t").alias("title"), "embedding")
    n = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("note_id"), F.md5(F.col("doc_id").cast("string")).alias("hash"))
    return N.legacy_blocks(e, n).select("note_id", "line", "hash")


_FOLDERS = "f AS (SELECT 'c' || c_custkey AS folder_id, 'n' || c_nationkey AS parent_id FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


def folders(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, d, "customer").select(name("c", "c_custkey").alias("folder_id"), name("n", "c_nationkey").alias("parent_id"))
    n = table(spark, d, "nation").select(name("n", "n_nationkey").alias("folder_id"), name("r", "n_regionkey").alias("parent_id"))
    return c.union(n).union(table(spark, d, "region").select(name("r", "r_regionkey").alias("folder_id"), F.lit("root").alias("parent_id")))


@query(f"WITH RECURSIVE {_FOLDERS}, s(folder_id, depth) AS (SELECT folder_id, 0 FROM f WHERE folder_id = 'r1' UNION ALL SELECT f.folder_id, depth + 1 FROM f JOIN s ON f.parent_id = s.folder_id) SELECT * FROM s")
def folder_closure(spark: SparkSession, d: str) -> DataFrame:
    return I.folder_closure(folders(spark, d), "r1")


@query(f"WITH {_FOLDERS} SELECT folder_id FROM f WHERE folder_id IN ('r1', 'x') OR parent_id = 'r1' OR parent_id IN (SELECT folder_id FROM f WHERE parent_id = 'r1') UNION SELECT 'x'")
def folder_exclude(spark: SparkSession, d: str) -> DataFrame:
    return I.set_folders(spark.createDataFrame([("x",), ("r1",)], "folder_id string"), folders(spark, d), "r1", exclude=True)


def _models(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    keys = F.filter(F.array(F.when(i % 2 == 0, "m"), F.when(i % 3 == 0, "n")), lambda x: x.isNotNull())
    return table(spark, d, "documents").select(i.alias("note_id"), F.map_from_arrays(keys, F.transform(keys, lambda k: F.length(k))).alias("models"))


@query("SELECT count(*) FILTER (doc_id % 6 = 0) AS updated, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS removed, count(*) FILTER (doc_id % 2 <> 0) AS skipped FROM documents")
def deletion_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.deletion_summary(_models(spark, d), "m")


@query("SELECT doc_id AS note_id, 'n' AS models FROM documents WHERE doc_id % 3 = 0")
def delete_model(spark: SparkSession, d: str) -> DataFrame:
    return G.delete_model(_models(spark, d), "m").select("note_id", F.array_join(F.map_keys("models"), ",").alias("models"))


@query("SELECT vec_id % 300 AS note_id, vec_id AS line FROM embeddings WHERE vec_id % 300 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 IN (1, 2))")
def excluded_cleanup(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = table(spark, d, "documents").select(i.alias("note_id"), F.when(i % 5 == 1, "excluded").when(i % 5 == 2, "orphan").when(i % 5 == 3, "excluded_kept").otherwise("unchanged").alias("status"))
    return I.drop_excluded(_blocks(spark, d), status)

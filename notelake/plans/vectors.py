"""Queries over vectors. Blocks are ``embeddings``: note_id = label, line = vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import api
from notelake.functions import vector as V
from notelake.functions.embed import HashingEmbedder
from notelake.operators import catalog
from notelake.operators import search as S
from notelake.operators.index import update_totals as update_totals_of
from notelake.operators.retrieve import scoped_pool
from notelake.plans.base import query
from notelake.storage import table


def blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("note_id"), F.col("vec_id").alias("line"), (F.lit(80) + F.col("vec_id") % 60).alias("length"), "embedding")


def query_vectors(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The first n vectors, as queries."""
    return blocks(spark, d).where(F.col("line") < n).select(F.col("line").alias("query_id"), F.col("embedding").alias("q"))


_B = "b AS (SELECT CAST(label AS BIGINT) AS note_id, vec_id AS line, 80 + vec_id % 60 AS length, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) END"
_SCALE = "CASE WHEN list_max(list_transform({v}, lambda x: abs(x))) = 0 THEN 1.0e0 ELSE list_max(list_transform({v}, lambda x: abs(x))) / 127.0e0 END"
_Q8 = f"SELECT note_id, line, length, s AS scale, list_transform(v, lambda x: CAST(greatest(-127, least(127, floor(x * (1.0e0 / s) + 0.5e0))) AS BIGINT)) AS q, v FROM (SELECT *, {_SCALE.format(v='v')} AS s FROM b)"
_ISUM = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_SCORED = f"s AS (SELECT q.line AS query_id, b.note_id, b.line, b.length, {_COS.format(a='b.v', b='q.v')} AS sim FROM b, b q WHERE q.line < {{n}})"


@query(
    f"""WITH {_B}, {_SCORED.format(n=1)}, own AS (SELECT note_id FROM b WHERE line = 0),
h AS (SELECT * FROM s WHERE sim >= 0.05 AND length >= 100 AND note_id NOT IN (SELECT note_id FROM own) ORDER BY sim DESC, note_id, line LIMIT 1536)
SELECT note_id, round(max(sim), 6) AS similarity, count(*) AS blocks, CAST(arg_min(line, (-sim, line)) AS BIGINT) AS best_line FROM h GROUP BY note_id ORDER BY max(sim) DESC, note_id LIMIT 10"""
)
def semantic_search_notes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    scored = S.score(b, query_vectors(spark, d, 1))
    own = b.where("line = 0").select("note_id").distinct()
    found = S.hits(scored, min_similarity=0.05, min_length=100).join(F.broadcast(own), "note_id", "left_anti")  # one id
    found = S.top_k(found, S.candidate_limit(10))
    notes = S.group_by_note(found, limit=10)
    return notes.select("note_id", F.round("similarity", 6).alias("similarity"), F.size("blocks").cast("long").alias("blocks"), F.col("blocks")[0]["line"].alias("best_line"))


@query(f"WITH {_B}, q AS ({_Q8}) SELECT line, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS q_sum, list_min(q) AS q_min, list_max(q) AS q_max, CAST({_ISUM.format(a='q', b='range(1, len(q) + 1)')} AS BIGINT) AS q_check FROM q")
def q8_quantize(spark: SparkSession, d: str) -> DataFrame:
    q = blocks(spark, d).select("line", F.round(V.q8_scale("embedding"), 9).alias("scale"), V.q8_values("embedding").cast("array<long>").alias("q"))
    place = F.transform("q", lambda x, i: x * (i + 1))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("line", "scale", add(F.col("q")).alias("q_sum"), F.array_min("q").alias("q_min"), F.array_max("q").alias("q_max"), add(place).alias("q_check"))


@query(f"WITH {_B}, q AS ({_Q8}) SELECT line, round(list_max(list_transform(list_zip(q, v), lambda p: abs(p[1] * scale - p[2]))), 9) AS max_error, list_max(list_transform(list_zip(q, v), lambda p: abs(p[1] * scale - p[2]))) <= scale * 0.500001 AS within FROM q")
def q8_dequantize_error(spark: SparkSession, d: str) -> DataFrame:
    q = blocks(spark, d).select("line", V.as_doubles("embedding").alias("v"), V.q8_scale("embedding").alias("scale"), V.q8_values("embedding").alias("q"))
    error = F.array_max(F.zip_with(V.dequantize("q", "scale"), "v", lambda a, b: F.abs(a - b)))
    return q.select("line", F.round(error, 9).alias("max_error"), (error <= F.col("scale") * 0.500001).alias("within"))


@query(f"WITH {_B}, q AS ({_Q8}), s AS (SELECT x.note_id, x.line, {_ISUM.format(a='x.q', b='y.q')} / sqrt(CAST({_ISUM.format(a='x.q', b='x.q')} * {_ISUM.format(a='y.q', b='y.q')} AS DOUBLE)) AS sim FROM q x, q y WHERE y.line = 0) SELECT note_id, line, round(sim, 6) AS similarity FROM s WHERE sim >= 0.05 ORDER BY sim DESC, note_id, line LIMIT 50")
def q8_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = S.matmul_top_k(S.quantised(blocks(spark, d)), query_vectors(spark, d, 1), 50, 0.05)
    return found.select("note_id", "line", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_B}, {_SCORED.format(n=5)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id, line) AS k FROM s) SELECT query_id, note_id, line, round(sim, 6) AS similarity FROM r WHERE k <= 20")
def f32_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = S.matmul_top_k(blocks(spark, d), query_vectors(spark, d, 5), 20)
    return found.select("query_id", "note_id", "line", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_B} SELECT line, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v))) * (x / sqrt(list_dot_product(v, v))))), 6) AS unit, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM b")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = blocks(spark, d).select("line", V.norm("embedding").alias("n"), V.l2_normalize("embedding").alias("u"))
    return u.select("line", F.round("n", 6).alias("norm"), F.round(V.dot("u", "u"), 6).alias("unit"), F.round(F.col("u")[0], 6).alias("first"))


_MEAN = "SELECT note_id, i - 1 AS i, round(sum(v[i] * w) / sum(w), 6) AS value FROM (SELECT note_id, v, {w} AS w, unnest(range(1, len(v) + 1)) AS i FROM b) GROUP BY note_id, i"


@query(f"WITH {_B} {_MEAN.format(w='1.0e0')}")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_vector(blocks(spark, d), ["note_id"])
    return m.select("note_id", F.posexplode("embedding").alias("i", "x")).select("note_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("value"))


@query(f"WITH {_B} {_MEAN.format(w='CAST(length AS DOUBLE)')}")
def weighted_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_vector(blocks(spark, d), ["note_id"], F.col("length"))
    return m.select("note_id", F.posexplode("embedding").alias("i", "x")).select("note_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("value"))


@query(
    f"""WITH {_B}, m AS (SELECT i, sum(v[i]) / count(*) AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM b WHERE note_id IN (1, 2)) GROUP BY i),
o AS (SELECT list(x ORDER BY i) AS o FROM m),
q AS (SELECT list_transform(list_zip(v, o), lambda p: p[1] * 0.7e0 + p[2] * 0.3e0) AS v FROM b, o WHERE line = 0),
s AS (SELECT b.note_id, b.line, {_COS.format(a='b.v', b='q.v')} AS sim FROM b, q)
SELECT note_id, line, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, note_id, line LIMIT 25"""
)
def link_blend_search(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    links = spark.sql("SELECT 0L AS query_id, explode(array(1L, 2L)) AS note_id")
    q = query_vectors(spark, d, 1).join(F.broadcast(S.linked_mean(b, links)), "query_id", "left").select("query_id", V.blend("q", "other", 0.3).alias("q"))  # one row
    return S.top_k(S.score(b, q), 25).select("note_id", "line", F.round("similarity", 6).alias("similarity"))


_MAXSIM = f"WITH {_B}, {_SCORED.format(n=5)}"


@query(f"{_MAXSIM} SELECT note_id, line, round(greatest(0, max(sim)), 6) AS similarity FROM s WHERE length >= 100 GROUP BY note_id, line")
def maxsim_pool(spark: SparkSession, d: str) -> DataFrame:
    scored = S.best_scores(blocks(spark, d).where("length >= 100"), query_vectors(spark, d, 5))
    return scored.select("note_id", "line", F.round(F.greatest(F.lit(0.0), "similarity"), 6).alias("similarity"))


@query(f"{_MAXSIM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, note_id, line) AS k FROM s WHERE sim >= 0.05) SELECT note_id, line, round(max(sim), 6) AS similarity FROM r WHERE k <= 40 GROUP BY note_id, line")
def maxsim_per_query_limit(spark: SparkSession, d: str) -> DataFrame:
    scored = S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 5)), min_similarity=0.05)
    return S.maxsim(scored, per_query_limit=40).select("note_id", "line", F.round("similarity", 6).alias("similarity"))


def _grouped(spark: SparkSession, d: str, method: str) -> DataFrame:
    scored = S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 1)), min_similarity=0.0)
    return S.group_by_note(scored, method=method, limit=10).select("note_id", F.round("similarity", 6).alias("similarity"), F.size("blocks").cast("long").alias("blocks"))


_GROUP = f"WITH {_B}, {_SCORED.format(n=1)} SELECT note_id, round({{f}}(sim), 6) AS similarity, count(*) AS blocks FROM s WHERE sim >= 0 GROUP BY note_id ORDER BY {{f}}(sim) DESC, note_id LIMIT 10"


@query(_GROUP.format(f="max"))
def group_notes_max(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "max")


@query(_GROUP.format(f="avg"))
def group_notes_avg(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "avg")


@query("SELECT h AS max_hits, least(greatest(64 * h, 1536), 8192) AS desktop, least(greatest(24 * h, 320), 800) AS mobile, 4 * least(greatest(64 * h, 1536), 8192) AS ungrouped FROM (SELECT unnest([1, 10, 24, 50, 100, 200]) AS h)")
def candidate_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = [(h, S.candidate_limit(h), S.candidate_limit(h, mobile=True), S.candidate_limit(h, grouped=False)) for h in (1, 10, 24, 50, 100, 200)]
    return spark.createDataFrame(rows, "max_hits int, desktop int, mobile int, ungrouped int")


@query(
    f"""WITH {_B}, q AS ({_Q8}), {_SCORED.format(n=1)},
t AS (SELECT note_id, line, sim, row_number() OVER (ORDER BY sim DESC, note_id, line) AS k FROM s WHERE sim >= 0.05 QUALIFY k <= 30),
f0 AS (SELECT x.note_id, x.line, {_ISUM.format(a='x.q', b='y.q')} / sqrt(CAST({_ISUM.format(a='x.q', b='x.q')} * {_ISUM.format(a='y.q', b='y.q')} AS DOUBLE)) AS sim FROM q x, q y WHERE y.line = 0),
f AS (SELECT note_id, line, sim, row_number() OVER (ORDER BY sim DESC, note_id, line) AS k FROM f0 WHERE sim >= 0.05 QUALIFY k <= 30),
j AS (SELECT t.k AS tk, f.k AS fk, t.sim AS ts, f.sim AS fs FROM t FULL JOIN f USING (note_id, line))
SELECT round(count(*) FILTER (tk IS NOT NULL AND fk IS NOT NULL) / greatest(1, count(fk)), 6) AS precision, round(count(*) FILTER (tk IS NOT NULL AND fk IS NOT NULL) / greatest(1, count(tk)), 6) AS recall,
round(count(*) FILTER (tk <= 10 AND fk <= 10) / greatest(1, count(*) FILTER (fk <= 10)), 6) AS precision_at_k, round(count(*) FILTER (tk <= 10 AND fk <= 10) / greatest(1, count(*) FILTER (tk <= 10)), 6) AS recall_at_k,
round(coalesce(avg(abs(tk - fk)), 0), 6) AS rank_difference, round(coalesce(avg(abs(ts - fs)), 0), 6) AS score_error FROM j"""
)
def validator_metrics(spark: SparkSession, d: str) -> DataFrame:
    b, q = blocks(spark, d), query_vectors(spark, d, 1)
    truth = S.ranked(S.top_k(S.hits(S.score(b, q), min_similarity=0.05), 30))
    m = S.precision_recall(truth, S.ranked(S.matmul_top_k(S.quantised(b), q, 30, 0.05)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("SELECT vec_id, round(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * (SELECT list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) FROM embeddings WHERE vec_id = 1)) END, 6) AS similarity FROM embeddings")
def cosine_dimension_guard(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select("line", F.when(F.col("line") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("v"))
    q = blocks(spark, d).where("line = 1").select(F.col("embedding").alias("q"))
    return b.crossJoin(F.broadcast(q)).select(F.col("line").alias("vec_id"), F.round(V.cosine("v", "q"), 6).alias("similarity"))  # one row


@query("SELECT dim, rows, CASE WHEN dim > 0 AND dim <= 2048 THEN CAST(ceil((rows * dim + rows * 68) * 1.15e0) AS BIGINT) END AS bytes, CASE WHEN dim > 0 AND dim <= 2048 THEN round(CAST(ceil((rows * dim + rows * 68) * 1.15e0) AS BIGINT) * 100.0e0 / 209715200, 6) END AS percent, CASE WHEN dim > 0 AND dim <= 2048 THEN CAST(ceil((rows * dim + rows * 68) * 1.15e0) AS BIGINT) * 100.0e0 / 209715200 >= 80 END AS warn FROM (SELECT unnest([0, 64, 1536, 1536, 4096]) AS dim, unnest([10, (SELECT count(*) FROM embeddings), 10000, 130000, 5]) AS rows)")
def cache_capacity(spark: SparkSession, d: str) -> DataFrame:
    n = blocks(spark, d).agg(F.count(F.lit(1)).alias("n"))
    rows = n.select(F.explode(F.arrays_zip(F.array(*map(F.lit, (0, 64, 1536, 1536, 4096))).alias("dim"), F.array(F.lit(10), F.col("n"), F.lit(10000), F.lit(130000), F.lit(5)).alias("rows"))).alias("x")).select("x.dim", F.col("x.rows").cast("long").alias("rows"))
    return rows.withColumn("c", catalog.capacity(F.col("rows"), F.col("dim"))).select("dim", "rows", "c.bytes", F.round("c.percent", 6).alias("percent"), "c.warn")


@query("SELECT dim, 4 * CAST(ceil(100 * dim / 3.0e0) AS BIGINT) + 4 * CAST(ceil(400 / 3.0e0) AS BIGINT) + 22000 AS bytes, greatest(1, CAST(floor(500000 / (4 * ceil(dim / 3.0e0) + 8 + 220)) AS BIGINT)) AS rows_per_shard FROM (SELECT unnest([64, 384, 768, 1536, 3072, 500000]) AS dim)")
def shard_size(spark: SparkSession, d: str) -> DataFrame:
    dims = spark.createDataFrame([(x,) for x in (64, 384, 768, 1536, 3072, 500000)], "dim int")
    return dims.select("dim", catalog.shard_bytes(F.col("dim"), F.lit(100)).alias("bytes"), catalog.shard_rows(F.col("dim")).alias("rows_per_shard"))


@query("SELECT CAST(label AS BIGINT) AS note_id, vec_id AS line FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= greatest(1, floor(5000 / (4 * ceil(64 / 3.0) + 8 + 220)))")
def shard_row_cap(spark: SparkSession, d: str) -> DataFrame:
    return catalog.cap_rows(blocks(spark, d), catalog.shard_rows(F.size("embedding"), 5000)).select("note_id", "line")


@query(f"WITH {_B}, q AS ({_Q8}), r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY line) AS n FROM q) SELECT CAST(note_id AS VARCHAR) AS note_id, n - 1 AS row_no, CAST(list_sum(q) AS BIGINT) AS q_sum, line AS line_number, round(CAST(CAST(scale AS FLOAT) AS DOUBLE), 9) AS scale FROM r WHERE n <= greatest(1, floor(500000 / (4 * ceil(64 / 3.0) + 8 + 220)))")
def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Blocks to base64 shards and back, by way of a two-phase write and an epoch-checked read."""
    from notelake.sources import shards
    from notelake.storage import fresh_path

    b = blocks(spark, d).withColumn("title", F.lit("t")).withColumn("level", F.lit(0)).withColumn("body_idx", F.lit(0)).withColumn("path", F.array(F.lit("t")))
    made = shards.build(b, "hash-64", 1)
    at = fresh_path(spark, "shards")
    shards.put(made, made.select("note_id", "model_id", "epoch"), f"{at}/emb", f"{at}/meta")
    rows = shards.read(spark, f"{at}/emb", f"{at}/meta", model_id="hash-64")
    total = F.aggregate("q8", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("note_id", F.col("row").cast("long").alias("row_no"), total.alias("q_sum"), F.col("meta.lineNumber").cast("long").alias("line_number"), F.round(F.col("scale").cast("double"), 9).alias("scale"))


@query(
    f"""WITH {_B}, s AS (SELECT b.note_id, b.line, b.length, max({_COS.format(a='b.v', b='q.v')}) AS sim FROM b, b q WHERE q.note_id = 3 AND b.note_id <> 3 GROUP BY ALL)
SELECT note_id, round(max(sim), 6) AS similarity, count(*) AS blocks FROM s WHERE sim >= 0.1 AND length >= 100 GROUP BY note_id ORDER BY max(sim) DESC, note_id LIMIT 5"""
)
def search_by_note(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of a note as queries, by way of the API."""
    b = blocks(spark, d)
    index = api.NoteIndex(b, b.select("note_id").distinct(), "m", HashingEmbedder(64))
    return index.search(note_id=3, limit=5, min_similarity=0.1).select("note_id", F.round("similarity", 6).alias("similarity"), F.size("blocks").cast("long").alias("blocks"))


_FOUND = f"WITH {_B}, {_SCORED.format(n=1)}, g AS (SELECT note_id, max(sim) AS sim FROM s WHERE sim >= 0 GROUP BY note_id)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("note_id")
    n = blocks(spark, d).select("note_id").distinct()
    return n.select(i, F.concat(F.lit("note "), i.cast("string")).alias("title"), (i % 5).cast("string").alias("folder_id"), (i == 7).alias("is_conflict"), F.when(i == 2, 5).otherwise(0).alias("deleted_time"))


@query(f"{_FOUND}, t AS (SELECT * FROM g ORDER BY sim DESC, note_id LIMIT 9) SELECT note_id, round(sim, 6) AS similarity FROM t WHERE note_id NOT IN (2, 7) AND note_id % 5 <> 1 ORDER BY sim DESC, note_id LIMIT 4")
def post_hit_exclusion(spark: SparkSession, d: str) -> DataFrame:
    found = S.group_by_note(S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 1)), min_similarity=0.0))
    shown = S.visible(found, _notes(spark, d), spark.createDataFrame([("1",), (" ",)], "folder_id string"), 4)
    return shown.select("note_id", F.round("similarity", 6).alias("similarity"))


@query(f"""{_FOUND}, t AS (SELECT * FROM g ORDER BY sim DESC, note_id LIMIT 4), k AS (SELECT doc_id % 10 AS note_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS tags FROM documents WHERE source IS NOT NULL AND doc_id % 10 <> 1 GROUP BY 1)
SELECT note_id, 'The note "note ' || note_id || '" has the keywords: ' || tags || '.' AS example FROM t JOIN k USING (note_id)""")
def tag_examples(spark: SparkSession, d: str) -> DataFrame:
    found = S.group_by_note(S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 1)), min_similarity=0.0), limit=4)
    tags = table(spark, d, "documents").where("source is not null and doc_id % 10 <> 1").select((F.col("doc_id") % 10).alias("note_id"), F.col("source").alias("tag"))
    return S.tag_examples(found, _notes(spark, d), tags).select("note_id", "example")


@query(f"WITH {_B} SELECT note_id, line FROM b WHERE note_id IN (1, 4) OR note_id IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 1)")
def chat_scope(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "benchmark").where("item_id % 2 = 1").select(F.col("item_id").alias("note_id"))
    return scoped_pool(blocks(spark, d), [1, 4], found)[0].select("note_id", "line")


@query(f"WITH {_B} SELECT count(DISTINCT note_id) AS notes, count(*) AS rows, CAST(max(len(v)) AS BIGINT) AS dim FROM b")
def update_totals(spark: SparkSession, d: str) -> DataFrame:
    return update_totals_of(blocks(spark, d))

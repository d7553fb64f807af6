"""Queries of lexical search, fusion and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import api
from notelake.operators import lexical as L
from notelake.operators import rag as R
from notelake.operators import search as S
from notelake.plans.base import query
from notelake.plans.text import _TOKENS, docs
from notelake.plans.vectors import _B, _SCORED, blocks, query_vectors
from notelake.storage import table

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _bm25_sql(words: tuple[str, ...], either: bool, limit: int = 1000) -> str:
    """BM25 of documents; the words in code point order, as the operator sums them."""
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(words))
    facts = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5e0) / (df{i} + 0.5e0)) * tf{i} * 2.2e0 / (tf{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / mean_len))" for i in range(len(words)))
    test = (" OR " if either else " AND ").join(f"tf{i} > 0" for i in range(len(words)))
    return f"""c AS (SELECT doc_id AS note_id, len(w) AS len, {tf} FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
facts AS (SELECT count(*) AS n, avg(len) AS mean_len, {facts} FROM c),
bm AS (SELECT note_id, {part} AS score FROM c, facts WHERE {test}),
ranked AS (SELECT note_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, note_id) AS rank FROM bm QUALIFY rank <= {limit})"""


@query(f"WITH {_bm25_sql(('from', 'that', 'the'), False)} SELECT note_id, round(score, 6) AS score FROM ranked")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(docs(spark, d), "the that from").select("note_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(('edthe', 'onthat'), True)} SELECT note_id, round(score, 6) AS score FROM ranked")
def bm25_any(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(docs(spark, d), "any:1 onthat edthe").select("note_id", F.round("score", 6).alias("score"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Ranked blocks for query 0: (note_id, line, similarity, position)."""
    found = S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 1)), min_similarity=0.0)
    return S.ranked(S.top_k(found, 200)).select("note_id", "line", "similarity", (F.col("rank") - 1).alias("position"))


_POOL = f"{_B}, {_SCORED.format(n=1)}, pool AS (SELECT note_id, line, sim, row_number() OVER (ORDER BY sim DESC, note_id, line) - 1 AS position FROM s WHERE sim >= 0 QUALIFY position < 200)"
_HITS = "hits AS (SELECT unnest([3, 1, 7]) AS note_id, unnest([1, 2, 3]) AS hit)"
_CHUNKS = "chunks AS (SELECT p.note_id, p.line, row_number() OVER (ORDER BY hit, sim DESC, p.note_id, p.line) - 1 AS position FROM pool p JOIN hits USING (note_id))"
_RRF = "fused AS (SELECT note_id, line, sum(part) AS score FROM (SELECT note_id, line, 1.0e0 / (1 + position) AS part FROM pool WHERE position < {n} UNION ALL SELECT note_id, line, 0.3e0 / (1 + position) FROM chunks) GROUP BY note_id, line)"


def _hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, 1), (1, 2), (7, 3)], "note_id long, rank int")


@query(f"WITH {_POOL}, {_HITS}, {_CHUNKS} SELECT * FROM chunks")
def keyword_chunks(spark: SparkSession, d: str) -> DataFrame:
    return L.keyword_chunks(_pool(spark, d).drop("position"), _hits(spark)).select("note_id", "line", F.col("position").cast("long").alias("position"))


@query(f"WITH {_POOL}, {_HITS}, {_CHUNKS}, {_RRF.format(n=200)} SELECT note_id, line, round(score, 9) AS score FROM fused")
def rrf_merge(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return L.rrf(pool, L.keyword_chunks(pool.drop("position"), _hits(spark))).select("note_id", "line", F.round("score", 9).alias("score"))


@query(f"WITH {_POOL}, {_HITS}, {_CHUNKS}, {_RRF.format(n=10)}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, note_id, line) AS lead FROM fused QUALIFY lead <= 10) SELECT p.note_id, p.line, row_number() OVER (ORDER BY lead NULLS LAST, position) - 1 AS place FROM pool p LEFT JOIN top USING (note_id, line)")
def keyword_rerank(spark: SparkSession, d: str) -> DataFrame:
    return L.rerank(_pool(spark, d), [_hits(spark)], max_hits=10).select("note_id", "line", F.col("place").cast("long").alias("place"))


@query(
    """WITH a AS (SELECT item_id, 'SEARCH: ' || replace(replace(text, chr(10), ' '), '|', ' ') || ' | KEYWORDS: ' || CASE WHEN item_id % 3 = 0 THEN 'NONE' ELSE 'red, blue sky' END AS line FROM benchmark)
SELECT item_id, trim(regexp_extract(line, '(?i)SEARCH:\\s*([^|]*)', 1)) AS search, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'red/any:1 blue sky' END AS keywords FROM a"""
)
def decompose_parse(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    head = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(" "))
    answer = F.concat(F.lit("Here:\nSEARCH: "), head, F.lit(" | KEYWORDS: "), F.when(F.col("item_id") % 3 == 0, "NONE").otherwise("red, blue sky"))
    found = b.select("item_id", L.parse_decomposition(answer)[0].alias("p"))
    return found.select("item_id", "p.search", F.array_join("p.keywords", "/").alias("keywords"))


@query(
    f"""WITH {_B}, o AS (SELECT note_id, line, row_number() OVER (PARTITION BY note_id ORDER BY line) AS place FROM b), h AS (SELECT note_id, place FROM o WHERE line % 50 = 7)
SELECT DISTINCT o.note_id, o.line FROM o JOIN h ON o.note_id = h.note_id AND o.place BETWEEN h.place - 1 AND h.place + 2"""
)
def neighbor_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return R.neighbours(b, b.where("line % 50 = 7"), before=1, after=2).select("note_id", "line")


#: Tokens of a context: that of a model with a long window.
CONTEXT = 200_000


def _context(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents")
    ranked = b.select((F.col("doc_id") % 9).alias("note_id"), F.col("doc_id").alias("line"), ((F.col("doc_id") * 37) % 199 * 1_000_000_000 + F.col("doc_id")).alias("rank"), F.lit("T").alias("title"), F.concat(F.lit("h"), (F.col("doc_id") % 4).cast("string")).alias("heading"), "text")
    return R.context(ranked, CONTEXT)


_CTX = f"""c AS (SELECT doc_id % 9 AS note_id, doc_id AS line, (doc_id * 37) % 199 * 1000000000 + doc_id AS rank, 'T ::: h' || (doc_id % 4) AS shown, text FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, sum({_TOKENS.format(t='text')} + 20) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM c QUALIFY running <= {CONTEXT}),
o AS (SELECT *, min(rank) OVER (PARTITION BY note_id) AS seen FROM k),
f AS (SELECT *, CASE WHEN lag(note_id) OVER w IS NOT DISTINCT FROM note_id AND lag(shown) OVER w IS NOT DISTINCT FROM shown THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS place FROM o WINDOW w AS (ORDER BY seen, note_id, line, rank))"""


@query(f"WITH {_CTX} SELECT note_id, line, CAST(running AS BIGINT) AS running FROM k")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("note_id", "line", F.col("running").cast("long").alias("running"))


@query(f"WITH {_CTX} SELECT note_id, line, shown, CAST(sum(fresh) OVER (ORDER BY place) AS BIGINT) AS citation, place FROM f")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("note_id", "line", "shown", F.col("citation").cast("long").alias("citation"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_B}, {_SCORED.format(n=1)}, h AS (SELECT note_id, line, round(sim, 4) AS sim FROM s WHERE sim >= 0.1), g AS (SELECT note_id, max(sim) AS m, list({{'line': line, 'similarity': sim}} ORDER BY sim DESC, line) AS blocks FROM h GROUP BY note_id)
SELECT note_id, CAST(note_id AS VARCHAR) AS id, CAST(m AS VARCHAR) AS similarity, CAST(len(blocks) AS BIGINT) AS blocks, CAST(blocks[1].line AS VARCHAR) AS first_line FROM g ORDER BY m DESC, note_id LIMIT 10"""
)
def api_search_json(spark: SparkSession, d: str) -> DataFrame:
    found = S.hits(S.score(blocks(spark, d), query_vectors(spark, d, 1)), min_similarity=0.1).withColumn("similarity", F.round("similarity", 4))
    made = api.serialise(S.group_by_note(found, limit=10))
    j = lambda p: F.get_json_object("json", p)
    return made.select("note_id", j("$.id").alias("id"), j("$.similarity").alias("similarity"), F.size(F.from_json(j("$.blocks"), "array<string>")).cast("long").alias("blocks"), j("$.blocks[0].line").alias("first_line"))


@query(f"WITH {_POOL}, {_HITS}, {_CHUNKS}, {_RRF.format(n=10)}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, note_id, line) AS lead FROM fused QUALIFY lead <= 10), o AS (SELECT p.*, row_number() OVER (ORDER BY lead NULLS LAST, position) - 1 AS place FROM pool p LEFT JOIN top USING (note_id, line)) SELECT note_id, round(max(sim), 6) AS similarity, min(place) AS place FROM o GROUP BY note_id ORDER BY max(sim) DESC, min(place), note_id LIMIT 5")
def search_by_query(spark: SparkSession, d: str) -> DataFrame:
    """Flat search, keyword rerank, notes: (note_id, similarity, place of its first block)."""
    found = L.rerank(_pool(spark, d), [_hits(spark)], max_hits=10)
    first = found.groupBy("note_id").agg(F.min("place").cast("long").alias("place"))
    return S.group_by_note(found, limit=5).join(first, "note_id").select("note_id", F.round("similarity", 6).alias("similarity"), "place")

"""Queries over saved records, headings, cleaned vectors and short forms. Records are made of ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import api
from notelake.functions import embed as E
from notelake.functions import text as T
from notelake.functions import vector as V
from notelake.operators import catalog as G
from notelake.operators import chunk as C
from notelake.operators import lexical as L
from notelake.operators import search as Q
from notelake.plans.base import query
from notelake.plans.text import _TOKENS
from notelake.sources import literature as R
from notelake.sources import shards as S
from notelake.storage import table


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def text(c: str) -> Column:
    return F.col(c).cast("string")


_HEADINGS = """b AS (SELECT *, 'About ' || p_name || '.' || chr(10) || '# ' || p_brand || chr(10) AS one, 'first ' || p_type || '.' || chr(10) || '### Deep' || chr(10) AS two, 'deep ' || p_name || '!' || chr(10) || '```sql' || chr(10) || 'SELECT ' || p_size || chr(10) || '```' || chr(10) || '# Last' || chr(10) AS three FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS note_id, 0 AS block_no, 1 AS line, 0 AS body_idx, CAST(length(p_name) + 9 AS INTEGER) AS length, 0 AS level, p_name AS title, p_name AS path, p_name || '/' || p_name || ':' || chr(10) || 'tags: part' || chr(10) || 'About ' || p_name || '.' || chr(10) || chr(10) AS decorated FROM b
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 3, CAST(length(one) AS INTEGER), CAST(length(p_type) + 9 AS INTEGER), 1, p_brand, p_name || '>' || p_brand, p_name || '/' || p_brand || ':' || chr(10) || 'tags: part' || chr(10) || 'first ' || p_type || '.' || chr(10) || chr(10) FROM b
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 5, CAST(length(one) + length(two) AS INTEGER), CAST(length(p_name) + 8 AS INTEGER), 3, 'Deep', p_name || '>' || p_brand || '>Deep', p_name || '/' || p_brand || '/Deep:' || chr(10) || 'tags: part' || chr(10) || 'deep ' || p_name || '!' || chr(10) || chr(10) FROM b
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 3, 10, CAST(length(one) + length(two) + length(three) AS INTEGER), 5, 1, 'Last', p_name || '>Last', p_name || '/Last:' || chr(10) || 'tags: part' || chr(10) || 'end.' || chr(10) FROM b"""


def headed(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("About "), "p_name", F.lit(".\n# "), "p_brand", F.lit("\nfirst "), "p_type", F.lit(".\n### Deep\ndeep "), "p_name", F.lit("!\n```sql\nSELECT "), text("p_size"), F.lit("\n```\n# Last\nend."))
    return part(spark, d).select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), body.alias("body"), F.array(F.lit("part")).alias("tags"))


@query(f"WITH {_HEADINGS}")
def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings carried forward as a path that a higher heading clears; code is left out."""
    return C.chunk_notes(headed(spark, d)).drop("chunk").withColumn("path", F.array_join("path", ">"))


@query(f"WITH c AS (WITH {_HEADINGS}), n AS (SELECT CAST(p_partkey AS VARCHAR) AS note_id, 'About ' || p_name || '.' || chr(10) || '# ' || p_brand || chr(10) || 'first ' || p_type || '.' || chr(10) || '### Deep' || chr(10) || 'deep ' || p_name || '!' || chr(10) || '```sql' || chr(10) || 'SELECT ' || p_size || chr(10) || '```' || chr(10) || '# Last' || chr(10) || 'end.' AS body FROM part) SELECT note_id, block_no, CASE WHEN body_idx + length <= length(body) THEN substring(body, body_idx + 1, length) END AS text FROM c JOIN n USING (note_id)")
def block_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of blocks by their offsets; a block that passes the body's end has none."""
    notes = headed(spark, d)
    return api.attach_text(C.chunk_notes(notes), notes.withColumn("note_id", text("note_id"))).select("note_id", "block_no", "text")


@query("SELECT p_name AS title, p_brand AS author, 2000 + p_size AS year, p_type AS journal, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, p_size AS citation_count, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'abstract' ELSE 'unknown' END AS text_source FROM part")
def index_papers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    entry = F.struct(F.col("p_name").alias("dc:title"), F.col("p_brand").alias("dc:creator"), F.col("p_type").alias("prism:publicationName"), F.concat((F.lit(2000) + F.col("p_size")).cast("string"), F.lit("-01-02")).alias("prism:coverDate"), F.when(i % 2 == 0, F.concat(F.lit("10.1/"), i.cast("string"))).alias("prism:doi"), text("p_size").alias("citedby-count"), F.when(i % 3 == 0, F.col("p_type")).alias("dc:description"))
    answers = part(spark, d).select(F.to_json(F.struct(F.struct(F.array(entry).alias("entry")).alias("search-results"))).alias("json"))
    return R.from_index(answers).select("title", "author", "year", "journal", "doi", "citation_count", "text", "text_source")


@query("SELECT p_partkey AS page_id, p_name AS title, p_type AS text FROM part")
def encyclopedia_pages(spark: SparkSession, d: str) -> DataFrame:
    extract = F.concat(F.lit("<p class='x'>\n"), "p_type", F.lit("</p>\n"))
    page = F.struct(F.col("p_partkey").alias("pageid"), F.col("p_name").alias("title"), extract.alias("extract"))
    answers = part(spark, d).select(F.to_json(F.struct(F.struct(F.create_map(text("p_partkey"), page).alias("pages")).alias("query"))).alias("json"))
    return R.from_encyclopedia(answers)


_ANSWERS = "g AS (SELECT p_brand AS search, p_partkey AS id, p_size, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)"


def per_brand(spark: SparkSession, d: str, *rows: Column, name: str) -> DataFrame:
    """(search, <name>): an array of structs for each brand, by key."""
    groups = part(spark, d).groupBy(F.col("p_brand").alias("search")).agg(F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("k"), *rows))).alias("rows"))
    return groups.withColumn(name, F.transform("rows", lambda r: r.dropFields("k"))).drop("rows")


@query(f"WITH {_ANSWERS} SELECT id AS page_id, p_name AS title, 2000 + p_size AS year, CAST(i AS INTEGER) AS place FROM g WHERE i < 20 AND id % 7 > 0")
def encyclopedia_search(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 hits of each search; one without a page id keeps its place."""
    i = F.col("p_partkey")
    hits = per_brand(spark, d, F.when(i % 7 > 0, i).alias("pageid"), F.col("p_name").alias("title"), F.concat((F.lit(2000) + F.col("p_size")).cast("string"), F.lit("-03-04T05:06:07Z")).alias("timestamp"), name="search_")
    return R.encyclopedia_hits(hits.select(F.to_json(F.struct(F.struct(F.col("search_").alias("search")).alias("query"))).alias("json")))


@query(f"WITH {_ANSWERS}, f AS (SELECT search, p_size, min(i) AS i FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY i) - 1 AS place FROM f QUALIFY place < 30) SELECT search, CAST(place // 4 AS INTEGER) AS batch, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY place) AS pmids FROM r GROUP BY ALL")
def pubmed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two pages of each search, the later repeating the earlier, in groups of four."""
    ids = per_brand(spark, d, text("p_size").alias("id"), name="ids").select("search", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("page"), F.col("ids.id").alias("ids"))
    pages = ids.select("search", "page", F.to_json(F.struct(F.struct(F.col("ids").alias("idlist")).alias("esearchresult"))).alias("json"))
    return R.id_batches(R.found_ids(pages, 30), 4)


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_partkey % 3 = 2 THEN p_size + 1 ELSE p_size END AS cited FROM part WHERE p_partkey % 5 > 0")
def citation_answers(spark: SparkSession, d: str) -> DataFrame:
    """Citation counts under any of their names; negative ones and records without an id don't count."""
    i, n = F.col("p_partkey"), F.col("p_size")
    counts = F.when(i % 5 == 0, F.map_from_arrays(F.array(F.lit("citation_count")), F.array(F.lit("-1")))).when(i % 3 == 0, F.create_map(F.lit("citation_count"), n.cast("string")))
    counts = counts.when(i % 3 == 1, F.create_map(F.lit("citedByPmidCount"), n.cast("string"), F.lit("citedbyPmidCount"), F.lit("0"))).otherwise(F.create_map(F.lit("citedbyPmidCount"), (n + 1).cast("string")))
    record = F.map_concat(F.create_map(F.lit("pmid"), F.when(i % 10 == 0, "").otherwise(text("p_partkey"))), counts)
    return R.from_citations(part(spark, d).select(F.to_json(F.struct(F.array(record).alias("data"))).alias("json")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmcid, upper(p_name) || chr(10) || chr(10) || 'Made of ' || p_type || ' here.' || chr(10) || chr(10) || '• ' || p_brand || chr(10) || '• size ' || p_size AS text FROM part")
def full_text_walk(spark: SparkSession, d: str) -> DataFrame:
    """Titles, paragraphs and lists of articles; references, tables and figures are passed over."""
    xml = F.concat(F.lit("<article><front><p>no</p></front><body><sec><title>"), "p_name", F.lit("</title><p>Made of <italic>"), "p_type", F.lit("</italic>\n <xref>12</xref>here.</p><table-wrap><p>no</p></table-wrap><list><list-item><p>"), "p_brand", F.lit("</p></list-item><list-item><p>size "), text("p_size"), F.lit("</p></list-item></list><fig><caption><p>no</p></caption></fig></sec></body><back><p>no</p></back></article>"))
    return R.full_texts(part(spark, d).select(text("p_partkey").alias("pmcid"), xml.alias("xml")))


@query("SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' ELSE '10.2/' END || p_partkey AS doi, CASE WHEN p_partkey % 2 > 0 THEN 'PMC' || p_size END AS pmcid, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'Group' WHEN 2 THEN 'AB' ELSE 'Unknown' END AS author, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1990 + p_size END AS year, 'Untitled' AS title, 'AIM: ' || p_name || chr(10) || chr(10) || p_type AS text FROM part")
def article_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids, first authors and years of article records; a location counts before a list, and works
    that are cited don't count."""
    i, key = F.col("p_partkey"), text("p_partkey")
    place = F.when(i % 2 == 0, F.concat(F.lit('<ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">doi:10.1/'), key, F.lit("</ELocationID>"))).otherwise("")
    listed = F.concat(F.lit('<ArticleIdList><ArticleId IdType="doi">10.2/'), key, F.lit("</ArticleId>"), F.when(i % 2 > 0, F.concat(F.lit('<ArticleId IdType="pmc">'), F.when(i % 3 == 0, "pmc").otherwise(""), text("p_size"), F.lit("</ArticleId>"))).otherwise(""), F.lit("</ArticleIdList>"))
    author = F.when(i % 4 == 0, F.concat(F.lit("<LastName>"), "p_brand", F.lit("</LastName>"))).when(i % 4 == 1, "<CollectiveName>Group</CollectiveName>").when(i % 4 == 2, "<Initials>AB</Initials>").otherwise("")
    date = F.when(i % 5 == 0, "<Season>Fall</Season>").when(i % 5 < 3, F.concat(F.lit("<Year>"), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit("</Year>"))).otherwise(F.concat(F.lit("<MedlineDate>"), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(" Jan-Feb</MedlineDate>")))
    head = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), key, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue></Journal>"), place)
    body = F.concat(F.lit('<Abstract><AbstractText Label="Aim">'), "p_name", F.lit("</AbstractText><AbstractText>"), "p_type", F.lit("</AbstractText></Abstract><AuthorList><Author>"), author, F.lit("</Author><Author><LastName>Second</LastName></Author></AuthorList></Article></MedlineCitation><PubmedData>"), listed)
    cited = '<ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/9</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>'
    return R.from_pubmed(part(spark, d).select(F.concat(head, body, F.lit(cited)).alias("xml"))).select(F.col("pmid").cast("long").alias("paper_id"), "doi", "pmcid", "author", "year", "title", "text")


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN (i + vec_id) % 3 = 0 THEN 0.0e0 ELSE CAST(embedding[i] AS DOUBLE) * i END)), 6) AS checksum, CAST(len(list_filter(range(1, len(embedding) + 1), lambda i: (i + vec_id) % 3 <> 0)) AS BIGINT) AS finite FROM embeddings")
def sanitize_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Values that aren't finite become 0."""
    bad = lambda x, i: F.when((i + 1 + F.col("vec_id")) % 3 == 0, F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", bad).alias("v")).withColumn("s", V.sanitize("v"))
    weighed = V.total(F.transform("s", lambda x, i: x * (i + 1)))
    return rows.select("vec_id", F.size("s").cast("long").alias("dim"), F.round(weighed, 6).alias("checksum"), F.size(F.filter("v", V.finite)).cast("long").alias("finite"))


@query(f"SELECT doc_id AS note_id, md5(text) AS hash FROM (SELECT doc_id, CASE WHEN n <= 32 THEN text ELSE left(text, CAST(floor(28.0e0 * length(text) / n * 0.95e0) AS BIGINT)) || ' [truncated]' END AS text FROM (SELECT doc_id, text, {_TOKENS.format(t='text')} AS n FROM documents))")
def truncate_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.md5(T.truncate_tokens("text", 32)).alias("hash"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'gpt-' || p_size WHEN p_partkey % 4 = 1 THEN 'model-' || p_size || '.5' WHEN p_partkey % 4 = 2 THEN 'm' ELSE 'embed-' || p_size END AS model, CASE WHEN p_size * 40000 >= 10485760 THEN '≈' || CAST(round(p_size * 40000 / 1048576.0e0) AS BIGINT) || ' MB' WHEN p_size * 40000 >= 1048576 THEN '≈' || format('{:.1f}', p_size * 40000 / 1048576.0e0) || ' MB' ELSE '≈' || CAST(round(p_size * 40000 / 1024.0e0) AS BIGINT) || ' KB' END AS bytes, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || chr(10) || p_type ELSE p_type END AS prompt FROM part")
def names_and_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Model ids without dates and release words, readable sizes, prompts of the parts that aren't blank."""
    i, size = F.col("p_partkey"), text("p_size")
    model = F.when(i % 4 == 0, F.concat(F.lit("gpt-"), size, F.lit("-2024-05-13"))).when(i % 4 == 1, F.concat(F.lit("model-"), size, F.lit(".5-latest"))).when(i % 4 == 2, "m-preview").otherwise(F.concat(F.lit("embed-"), size, F.lit("-exp")))
    return part(spark, d).select(i.alias("id"), T.model_name(model).alias("model"), T.format_bytes(F.col("p_size") * 40000).alias("bytes"), T.prompt(F.when(i % 2 == 0, F.col("p_name")), F.lit("  "), F.col("p_type")).alias("prompt"))


@query("WITH w AS MATERIALIZED (SELECT doc_id, r, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM (SELECT doc_id, 1 AS r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') AS w FROM documents))) SELECT d.doc_id AS note_id, coalesce(string_agg(w.w, ' ' ORDER BY i), '') AS term FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id AND n <= 300 GROUP BY d.doc_id")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), T.search_term("text").alias("term"))


class Lengths:
    """A stand-in model: the length of what it is asked for."""

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        return [[float(len(t)), float(kind == "query")] for t in texts]


@query("SELECT doc_id AS note_id, CAST(length(text) + 9 AS DOUBLE) AS asked, CAST(length(text) AS DOUBLE) AS stored FROM documents")
def conditioned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a model of the longest fitting adapter gets them: queries prefixed, documents bare."""
    how = E.resolve_adapter("Maker/Some Model-v2", {"some": E.DEFAULT, "some-model": E.Conditioning(query="question:")})
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("decorated"))
    asked = E.embed(docs, Lengths(), kind="query", conditioning=how).withColumnRenamed("embedding", "asked").drop("error")
    return E.embed(asked, Lengths(), conditioning=how).select("note_id", F.col("asked")[0].cast("double").alias("asked"), F.col("embedding")[0].cast("double").alias("stored"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS path, CASE WHEN p_partkey % 3 = 1 THEN '' WHEN p_partkey % 3 = 2 THEN p_brand ELSE p_name END AS title FROM part")
def block_titles(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of blocks: a path that is the title alone is left out; a title that is missing is
    the path's last part."""
    i = F.col("p_partkey")
    rows = part(spark, d).select(i.alias("id"), F.when(i % 3 == 0, F.col("p_name")).when(i % 3 == 1, "").alias("title"), F.when(i % 3 == 0, F.array("p_name")).otherwise(F.array("p_brand")).alias("path"), F.lit(1).alias("level"), F.lit(0).alias("body_idx"), F.lit(1).alias("length"), F.lit(1).alias("line"))
    return rows.select("id", S.row_meta().alias("meta")).select("id", F.array_join("meta.headingPath", "/").alias("path"), S.shown_title().alias("title"))


_TERMS = "p AS (SELECT vec_id AS note_id, label AS line, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings), k AS (SELECT *, CASE WHEN note_id % 5 = 0 THEN 0 WHEN note_id % 5 = 1 THEN 1 END AS term FROM p), c AS (SELECT *, row_number() OVER (ORDER BY term, CASE term WHEN 0 THEN note_id ELSE -note_id END) - 1 AS kpos FROM k WHERE term IS NOT NULL), s AS (SELECT note_id, line, sum(part) AS score FROM (SELECT note_id, line, 1.0e0 / (1 + position) AS part FROM p WHERE position < 20 UNION ALL SELECT note_id, line, 0.3e0 / (1 + kpos) FROM c) GROUP BY ALL), l AS (SELECT *, row_number() OVER (ORDER BY score DESC, note_id, line) AS lead FROM s ORDER BY lead LIMIT 20)"


@query(f"WITH {_TERMS} SELECT p.note_id, row_number() OVER (ORDER BY lead NULLS LAST, position) - 1 AS place FROM p LEFT JOIN l ON l.note_id = p.note_id")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    """Hits of two terms and a repeat of the first united by block, the earlier term first."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("label").alias("line"))
    pool = Q.ranked(rows.withColumn("similarity", -F.col("note_id").cast("double"))).withColumn("position", F.col("rank") - 1).drop("rank")
    hits = lambda rest, rank: rows.where(F.col("note_id") % 5 == rest).select("note_id", rank.alias("rank"))
    first, second = hits(0, F.col("note_id")), hits(1, -F.col("note_id"))
    return L.rerank(pool, [first, second, first], max_hits=20, notes_per_term=1 << 40).select("note_id", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT p_type AS model_name, 512 AS max_block_size FROM part")
def legacy_migration(spark: SparkSession, d: str) -> DataFrame:
    return G.migrate_legacy(part(spark, d).select(F.col("p_type").alias("model_name")).distinct())

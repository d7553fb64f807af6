"""Queries over texts: notes are ``documents`` (plain) and ``pages`` (HTML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import chunk as C
from notelake.operators import papers as P
from notelake.plans.base import query
from notelake.sources import html, notes
from notelake.storage import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("body"), "source")


@query("SELECT doc_id AS note_id, md5(text) AS hash, length(text) AS chars FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", T.content_hash("body").alias("hash"), F.length("body").cast("long").alias("chars"))


@query("SELECT md5(text) AS hash, count(*) AS notes, min(doc_id) AS first_note FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).groupBy(T.content_hash("body").alias("hash")).agg(F.count(F.lit(1)).alias("notes"), F.min("note_id").alias("first_note"))
    return n.where("notes > 1")


_CR = "replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END)"


@query(f"SELECT doc_id AS note_id, md5(regexp_replace({_CR}, '\\r\\n?', chr(10), 'g')) AS hash, md5({_CR}) AS raw_hash FROM documents")
def newline_normalize(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(F.col("note_id") % 3 == 0, "\r\n").when(F.col("note_id") % 3 == 1, "\r").otherwise("\n")
    raw = docs(spark, d).select("note_id", F.replace("body", F.lit("\n"), style).alias("body"))
    return raw.select("note_id", T.content_hash(T.normalize_newlines("body")).alias("hash"), T.content_hash("body").alias("raw_hash"))


@query("SELECT doc_id AS note_id, md5(regexp_replace(regexp_replace('<!-- a -->x' || chr(10) || 'y<!-- /a -->' || text || '<!-- a -->z<!-- /a -->', '<!-- a -->.*?<!-- /a -->', '', 'gs'), '```gen.*?```', '', 'gs')) AS hash FROM documents")
def strip_generated_blocks(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<!-- a -->x\ny<!-- /a -->"), "body", F.lit("<!-- a -->z<!-- /a -->"))
    return docs(spark, d).select("note_id", T.content_hash(T.strip_generated(body, [("<!-- a -->", "<!-- /a -->"), ("```gen", "```")])).alias("hash"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return html.html_to_text(table(spark, d, "pages").select("page_id", F.col("html").alias("body")))


_TOKENS = "CASE WHEN length({t}) = 0 THEN 0 ELSE CAST(ceil(length({t}) / CASE WHEN regexp_matches({t}, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}]') THEN 2.5e0 WHEN regexp_matches({t}, '[^\\x00-\\x7f]') THEN 3.2e0 WHEN (length({t}) - length(regexp_replace({t}, '[.,:;!?(){{}}\\[\\]\"''`]', '', 'g'))) / length({t}) > 0.1e0 THEN 3.5e0 ELSE 4.0e0 END) AS INTEGER) END"


@query(f"SELECT doc_id AS note_id, {_TOKENS.format(t='text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", T.token_estimate("body").alias("tokens"))


@query("SELECT doc_id AS note_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS hash FROM (SELECT doc_id, regexp_extract_all(text || chr(10), '[^.!?\\n]+[.!?\\n]+') AS s FROM documents)")
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    s = docs(spark, d).select("note_id", T.sentences("body").alias("s"))
    return s.select("note_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("hash"))


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text || chr(10), '[^.!?\\n]+[.!?\\n]+') AS s FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, c, {_TOKENS.format(t='c')} AS n FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS c FROM s) WHERE NOT starts_with(c, '#')),
c AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, n, CASE WHEN n <= 64 THEN c ELSE left(c, CAST(floor(60.0e0 * length(c) / n * 0.95e0) AS BIGINT)) || ' [truncated]' END AS c FROM x),
o AS MATERIALIZED (SELECT doc_id, i, n, c, CASE WHEN n <= 64 THEN n ELSE {_TOKENS.format(t='c')} END AS alone FROM c),
f AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS chunk, alone AS size FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, CASE WHEN f.size + o.n <= 64 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.size + o.n <= 64 THEN f.size + o.n ELSE o.alone END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1),
t AS (SELECT doc_id, chunk, string_agg(c, '' ORDER BY i) AS c FROM f JOIN o USING (doc_id, i) GROUP BY ALL)
SELECT doc_id AS note_id, max(chunk) AS chunks, md5(string_agg(c, '|' ORDER BY chunk)) AS hash FROM t GROUP BY doc_id"""
)
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = docs(spark, d).select("note_id", C.pack_sentences(T.sentences("body"), 64).alias("p"))
    return packed.select("note_id", F.size("p").cast("long").alias("chunks"), F.md5(F.array_join("p", "|")).alias("hash")).where("chunks > 0")


@query()
def chunk_notes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of HTML notes turned to Markdown-like text, with heading paths and decoration."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("note_id"), F.concat(F.lit("page "), F.col("page_id")).alias("title"), F.col("html").alias("body"), F.array(F.lit("web")).alias("tags"))
    return C.chunk_notes(html.html_to_text(pages), C.Options(max_tokens=128))


@query("SELECT doc_id AS note_id, strpos(text, 'ing') AS at, CASE WHEN strpos(text, 'ing') = 0 THEN 0 ELSE length(left(text, strpos(text, 'ing') - 1)) - length(replace(left(text, strpos(text, 'ing') - 1), chr(10), '')) + 1 END AS line FROM documents")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", F.instr("body", "ing").cast("long").alias("at"), T.line_number(F.col("body"), F.lit("ing")).cast("long").alias("line"))


@query("SELECT doc_id AS note_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-', ''), '-$', '') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", T.slug("body").alias("slug"))


@query("SELECT doc_id AS note_id, trim(regexp_replace('tag:' || source || ' ' || text || ' notebook:a1 title:x', '\\b(any|title|body|tag|notebook|created|updated|due|type|iscompleted|latitude|longitude|altitude|resource|sourceurl|id):\\S+', '', 'g')) AS query FROM documents")
def strip_query_operators(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("tag:"), "source", F.lit(" "), "body", F.lit(" notebook:a1 title:x"))
    return docs(spark, d).select("note_id", T.strip_query_operators(q).alias("query"))


_WORD = "regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')"


@query(f"SELECT doc_id AS note_id FROM documents WHERE {_WORD.format(w='the')} AND {_WORD.format(w='from')}")
def keyword_all(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(T.matches_keywords("body", "the from")).select("note_id")


@query("SELECT doc_id AS note_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])erth')")
def keyword_prefix(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(T.matches_keywords("body", "erth*")).select("note_id")


@query("SELECT doc_id AS note_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])that the([^A-Za-z0-9_]|$)')")
def keyword_phrase(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(T.matches_keywords("body", '"that the"')).select("note_id")


@query("SELECT doc_id AS note_id, 'doc ' || doc_id || '/' || source || ':' || chr(10) || 'tags: ' || lang || ', all' || chr(10) AS decorated FROM documents")
def decoration(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents")
    made = T.decoration(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.array(), F.col("source"), F.array("lang", F.lit("all")))
    return n.select(F.col("doc_id").alias("note_id"), made.alias("decorated"))


@query("SELECT doc_id AS note_id, CASE WHEN length(text) <= 50 THEN text ELSE left(text, 23) || '....' || right(text, 23) END AS short, regexp_extract(doc_id || '-' || left(text, 5), '^[\\d\\-/.]+', 0) AS prefix, regexp_replace('see [note ' || doc_id || ']', '(?i)\\[note\\s*(\\d+)\\]', '[\\1]', 'g') AS cited FROM documents")
def short_forms(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("note_id").cast("string")
    return docs(spark, d).select("note_id", T.middle_truncate("body", 50).alias("short"), T.title_prefix(F.concat(i, F.lit("-"), F.left("body", F.lit(5)))).alias("prefix"), T.plain_citations(F.concat(F.lit("see [note "), i, F.lit("]"))).alias("cited"))


@query("SELECT doc_id AS note_id, replace(replace(replace(replace(replace(text || '<a & \"b\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", T.escape_html(F.concat("body", F.lit('<a & "b">'))).alias("escaped"))


@query("SELECT doc_id AS note_id, '[' || (doc_id + 1) || ']: :/' || doc_id || CASE WHEN doc_id % 2 > 0 THEN '#my-title-' || doc_id ELSE '' END AS link, CASE WHEN doc_id % 3 = 0 THEN md5(text) || ',' || md5(source) ELSE md5(text) END AS links FROM documents")
def note_links(spark: SparkSession, d: str) -> DataFrame:
    """Links made and read; repeats, reference lines, commands and ids that are too short don't count."""
    i = F.col("note_id")
    made = T.reference_link(i + 1, i, i % 2, F.concat(F.lit("My  title! "), i.cast("string")))
    own, other = F.md5("body"), F.concat(F.lit("(:/"), F.md5("source"), F.lit("#part)"))
    lead = F.when(i % 3 == 0, "see").when(i % 3 == 1, "[7]:").otherwise("Notes:")
    body = F.concat(F.lit("[a](:/"), own, F.lit(") [b](:/short) [](:/"), F.md5(F.lit("x")), F.lit(")\n"), lead, F.lit(" [c]"), other, F.lit("\n[d](:/"), own, F.lit(")"))
    return docs(spark, d).select("note_id", made.alias("link"), F.array_join(T.internal_links(body, ("Notes:",)), ",").alias("links"))


@query("SELECT doc_id AS note_id, md5(text || chr(10) || '<!-- s -->' || chr(10) || 'new' || chr(10) || '<!-- /s -->') AS added, '<a>' || chr(10) || '<!-- s -->' || chr(10) || 'new' || chr(10) || '<!-- /s -->' || '<b>' AS replaced FROM documents")
def upsert_block(spark: SparkSession, d: str) -> DataFrame:
    put = lambda c: T.upsert_block(c, F.lit("new"), "<!-- s -->", "<!-- /s -->")
    return docs(spark, d).select("note_id", F.md5(put(F.col("body"))).alias("added"), put(F.lit("<a>\n<!-- s -->old\n$1<!-- /s --><b>")).alias("replaced"))


@query("SELECT DISTINCT lang AS tag FROM documents")
def tag_list(spark: SparkSession, d: str) -> DataFrame:
    return notes.all_tags(table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("lang").alias("tag")))


@query("SELECT DISTINCT doc_id AS note_id FROM documents WHERE lang IN ('de', 'fr')")
def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    return notes.with_tags(table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("lang").alias("tag")), ["de", "fr"])


@query("SELECT d.doc_id AS note_id, md5(d.text || coalesce(chr(10) || chr(10) || string_agg(b.text, chr(10) || chr(10) ORDER BY CAST(item_id AS VARCHAR)), '')) AS hash FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id % 7 GROUP BY d.doc_id, d.text")
def recognised_text(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "benchmark").select((F.col("item_id") % 7).alias("note_id"), F.col("item_id").cast("string").alias("resource_id"), F.col("text").alias("ocr_text"))
    return notes.append_recognised(docs(spark, d), res).select("note_id", F.md5("body").alias("hash"))


@query("SELECT doc_id AS note_id, length(text) AS chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("n_chars").alias("user_updated_time"), F.length("text").cast("long").alias("chars"))
    return notes.newest_first(n, 20).select("note_id", "chars")


@query("SELECT doc_id AS note_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("note_id"))
    return notes.by_ids(docs(spark, d), ids.union(ids)).select("note_id", "source")


@query("SELECT doc_id AS note_id, CASE WHEN strpos(text, 'the') = 0 THEN text ELSE left(text, length(text) - strpos(reverse(text), 'eht') - 2) || 'THE' || right(text, strpos(reverse(text), 'eht') - 1) END AS body FROM documents")
def replace_last(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("note_id", T.replace_last("body", "the", "THE").alias("body"))


@query("SELECT doc_id AS note_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' <b>&#39;A&amp;lt; end' AS body FROM documents WHERE NOT regexp_matches(text, '[<>&]')")
def clean_inline(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat("body", F.lit(" <i>&lt;b&gt;&#38;#39;&#x41;&amp;amp;lt;</i> end"))
    return docs(spark, d).where(~F.col("body").rlike("[<>&]")).select("note_id", T.clean_inline(marked).alias("body"))


@query(
    "SELECT doc_id AS note_id, length(text) AS chars, CAST(sum(t) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM (SELECT *, "
    + _TOKENS.format(t="text")
    + " AS t FROM documents WHERE text <> '') QUALIFY running <= 88000"
)
def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("place"), F.col("text").alias("excerpt"))
    kept = P.within_excerpts(pages, 100_000, 2_000)
    return kept.select(F.col("doc_id").alias("note_id"), F.length("excerpt").cast("long").alias("chars"), F.col("running").cast("long").alias("running"))


@query("SELECT doc_id AS note_id, len(string_split(text, ' ')) AS words FROM documents WHERE text IS NOT NULL")
def split_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to rows of at most 64 tokens and joined again: no word is lost."""
    cut = C.split_rows(docs(spark, d).where("body is not null").select("note_id", F.array("body").alias("parts")), "parts", 64)
    joined = F.array_join(F.flatten("rows"), " ")
    return cut.select("note_id", F.size(F.split(joined, " ")).cast("long").alias("words"))

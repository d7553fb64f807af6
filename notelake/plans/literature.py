"""Queries of the literature pipeline and of tags. Papers are ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import papers as P
from notelake.plans.base import query
from notelake.sources import literature as L
from notelake.storage import table

_P = """p AS (SELECT p_partkey AS paper_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || upper(p_brand) || (p_partkey % 50) END AS doi, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 90 AS VARCHAR) END AS pmid, 2000 + p_size % 5 AS year, p_size AS citation_count,
greatest(0.0e0, 1.0e0 - p_partkey / (SELECT CAST(count(*) AS DOUBLE) FROM part)) AS relevance_score, p_size % 2 = 1 AS full_text_available, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE repeat(p_type || ' ', 1 + p_size % 4) END AS summary FROM part)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    i, n = F.col("p_partkey"), p.count()
    return p.select(
        i.alias("paper_id"), F.col("p_name").alias("title"), F.when(i % 3 == 0, F.concat(F.lit("10.1/"), F.upper("p_brand"), (i % 50).cast("string"))).alias("doi"), F.when(i % 3 == 1, (i % 90).cast("string")).alias("pmid"), (F.lit(2000) + F.col("p_size") % 5).alias("year"), F.col("p_size").alias("citation_count"),
        P.relevance(i.cast("double"), F.lit(float(n))).alias("relevance_score"), (F.col("p_size") % 2 == 1).alias("full_text_available"), F.when(i % 11 == 0, " ").otherwise(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(1) + F.col("p_size") % 4)).alias("summary"),
    )


_KEY = "coalesce('doi:' || lower(doi), 'pmid:' || pmid, 'title:' || lower(title) || '-' || year)"


@query(f"WITH {_P} SELECT {_KEY} AS key, min(paper_id) AS paper_id FROM p GROUP BY 1")
def paper_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return P.dedupe(papers(spark, d), ["paper_id"]).select("key", "paper_id")


_PRIO = f"""{_P}, w AS (SELECT *, relevance_score AS r, ln(1 + citation_count) / ln(1 + (SELECT max(citation_count) FROM p)) AS c, CASE WHEN full_text_available THEN 1.0e0 ELSE 0.0e0 END AS f FROM p),
s AS (SELECT *, r * 0.5e0 + c * 0.3e0 + f * 0.2e0 AS score FROM w),
pin AS (SELECT paper_id, min(k) AS k FROM (SELECT arg_min(paper_id, (-round(r, 9), -round(score, 9), paper_id)) AS paper_id, 0 AS k FROM s UNION ALL SELECT arg_min(paper_id, (-round(c, 9), -round(score, 9), paper_id)), 1 FROM s UNION ALL SELECT arg_min(paper_id, (-f, -round(score, 9), paper_id)), 2 FROM s) GROUP BY paper_id),
o AS (SELECT s.*, row_number() OVER (ORDER BY k NULLS LAST, round(score, 9) DESC, paper_id) AS place FROM s LEFT JOIN pin USING (paper_id))"""


@query(f"WITH {_PRIO} SELECT paper_id, round(score, 6) AS selection_score, place <= 3 AS first FROM o")
def paper_prioritize(spark: SparkSession, d: str) -> DataFrame:
    return P.prioritize(papers(spark, d)).select("paper_id", F.round("selection_score", 6).alias("selection_score"), (F.col("place") <= 3).alias("first"))


@query(f"WITH {_PRIO}, b AS (SELECT paper_id, sum(length(summary)) OVER (ORDER BY place) AS running FROM o WHERE trim(summary) <> '') SELECT count(*) AS papers, CAST(max(running) AS BIGINT) AS used FROM b WHERE running <= 4000")
def paper_budget(spark: SparkSession, d: str) -> DataFrame:
    kept = P.within_budget(P.prioritize(papers(spark, d)), 4000, F.length("summary"))
    return kept.agg(F.count(F.lit(1)).alias("papers"), F.max("running").alias("used"))


@query(f"WITH {_P} SELECT paper_id, '- ' || CASE WHEN paper_id % 2 = 0 THEN 'Doe ' ELSE '' END || 'et al., [' || title || '](https://doi.org/' || coalesce(doi, '') || '), ' || CASE WHEN paper_id % 3 = 0 THEN 'J, ' ELSE '' END || year || ', cited: ' || citation_count || '.' AS line FROM (SELECT *, title AS t FROM p)")
def citation_lines(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).withColumn("author", F.when(F.col("paper_id") % 2 == 0, "Doe")).withColumn("journal", F.when(F.col("paper_id") % 3 == 0, "J"))
    return p.select("paper_id", P.citation_line().alias("line"))


@query(f"WITH {_P} SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN citation_count ELSE CASE WHEN pmid IS NULL THEN citation_count ELSE CAST(pmid AS INTEGER) + 1 END END AS citation_count FROM p")
def citation_map(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    cited = p.where("pmid is not null").select("paper_id", F.concat("pmid", F.lit("/"), F.col("paper_id").cast("string")).alias("pmid"), F.when(F.col("paper_id") % 4 == 0, -1).otherwise(F.col("pmid").cast("int") + 1).alias("cited"))
    keyed = p.withColumn("pmid", F.concat("pmid", F.lit("/"), F.col("paper_id").cast("string")))
    return L.with_citations(keyed, cited.select("pmid", "cited")).select("paper_id", "citation_count")


@query("SELECT p_name AS title, 'A' || (p_partkey % 10) AS author, 2000 + p_size AS year, p_brand AS journal, '10.1/' || p_partkey AS doi, p_size AS citation_count, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS text, CASE WHEN p_partkey % 2 = 0 THEN 'abstract' ELSE 'unknown' END AS text_source FROM part")
def graph_papers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    data = F.struct(F.col("p_name").alias("title"), F.when(i % 2 == 0, F.col("p_type")).alias("abstract"), (F.lit(2000) + F.col("p_size")).alias("year"), F.col("p_size").alias("citationCount"), F.struct(F.col("p_brand").alias("name")).alias("journal"), F.array(F.struct(F.concat(F.lit("A"), (i % 10).cast("string")).alias("name"))).alias("authors"), F.struct(F.concat(F.lit("10.1/"), i.cast("string")).alias("DOI")).alias("externalIds"))
    answers = table(spark, d, "part").select(F.to_json(F.struct(F.array(data).alias("data"))).alias("json"))
    return L.from_graph(answers).select("title", "author", "year", "journal", "doi", "citation_count", "text", "text_source")


@query("SELECT p_name AS title, 'Doe' AS author, 2000 + p_size AS year, p_type AS text, CAST(p_partkey AS VARCHAR) AS pmid, 'abstract' AS text_source FROM part")
def pubmed_papers(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), F.col("p_partkey").cast("string"), F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>"), (F.lit(2000) + F.col("p_size")).cast("string"), F.lit("</Year></PubDate></JournalIssue></Journal><ArticleTitle>"), "p_name", F.lit("</ArticleTitle><Abstract><AbstractText>"), "p_type", F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"))
    return L.from_pubmed(table(spark, d, "part").select(xml.alias("xml"))).select("title", "author", "year", "text", "pmid", "text_source")


@query("SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE p_brand END AS text FROM part")
def text_fallback(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    p = table(spark, d, "part").select(i.alias("paper_id"), F.when(i % 3 == 0, F.col("p_name")).otherwise(" ").alias("publisher"), F.when(i % 3 == 1, F.col("p_type")).alias("graph"), F.col("p_brand").alias("index"))
    return p.select("paper_id", P.first_text("publisher", "graph", "index").alias("text"))


@query("SELECT p_partkey AS note_id, array_to_string(list_concat(CASE WHEN p_partkey % 2 = 0 THEN ['old'] ELSE [] END, CASE WHEN p_type = 'ECONOMY' THEN ['economy'] ELSE [] END), '/') AS tags FROM part")
def tag_postprocess(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    answer = F.concat(F.col("p_type"), F.lit(" , nonsense,"), F.col("p_type"))
    bank, old = F.array(F.lit("economy"), F.lit("old")), F.array(F.lit("old"))
    keep = F.when(F.col("p_partkey") % 2 == 0, P.select_tags(answer, bank, old, keep_existing=True)).otherwise(P.select_tags(answer, bank, old))
    return p.select(F.col("p_partkey").alias("note_id"), F.array_join(keep, "/").alias("tags"))


@query("SELECT p_partkey AS paper_id, p_name || '/' || p_type AS queries FROM part")
def query_list(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("# Title\n# Research questions\nwhy?\n# Queries\n1. "), "p_name", F.lit("\n2. "), "p_type", F.lit("\n"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.array_join(P.parse_plan(answer)["queries"], "/").alias("queries"))

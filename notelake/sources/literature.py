"""Literature records: mapping of saved service answers (JSON, XML) to one paper schema."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAPER_COLUMNS = ("title", "author", "year", "journal", "doi", "citation_count", "text", "pmid", "pmcid", "text_source")
GRAPH_JSON = "struct<data:array<struct<title:string,abstract:string,year:int,citationCount:int,journal:struct<name:string>,authors:array<struct<name:string>>,externalIds:struct<DOI:string,PubMed:string>>>>"
INDEX_JSON = "struct<`search-results`:struct<entry:array<struct<`dc:title`:string,`dc:creator`:string,`prism:publicationName`:string,`prism:coverDate`:string,`prism:doi`:string,`citedby-count`:string,`dc:description`:string>>>>"
ENCYCLOPEDIA_JSON = "struct<query:struct<pages:map<string,struct<pageid:long,title:string,extract:string>>>>"
HITS_JSON = "struct<query:struct<search:array<struct<pageid:long,title:string,timestamp:string>>>>"
IDS_JSON = "struct<esearchresult:struct<idlist:array<string>>>"
CITED_JSON = "struct<data:array<map<string,string>>>"
#: Elements of an article whose text isn't read. Fixed values.
UNREAD = frozenset(("xref", "ref-list", "references", "table-wrap", "table", "fig", "figure", "footnote", "caption", "back", "supplementary-material", "app-group", "app", "sec-meta", "notes", "def-list", "chem-struct-wrap"))


def _papers(rows: DataFrame, **columns) -> DataFrame:
    kinds = {"year": "int", "citation_count": "int"}
    return rows.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in PAPER_COLUMNS])


def from_graph(answers: DataFrame) -> DataFrame:
    """Papers of a scholarly graph's answers (json)."""
    r = answers.select(F.explode(F.from_json("json", GRAPH_JSON)["data"]).alias("p"))
    text = F.coalesce(F.col("p.abstract"), F.lit(""))
    return _papers(r, title=F.col("p.title"), author=F.try_element_at("p.authors", F.lit(1))["name"], year=F.col("p.year"), journal=F.col("p.journal.name"), doi=F.col("p.externalIds.DOI"), citation_count=F.col("p.citationCount"), pmid=F.col("p.externalIds.PubMed"), text=text, text_source=F.when(text != "", "abstract").otherwise("unknown"))


def from_index(answers: DataFrame) -> DataFrame:
    """Papers of a citation index's answers (json)."""
    r = answers.select(F.explode(F.from_json("json", INDEX_JSON)["search-results"]["entry"]).alias("p"))
    c = lambda n: F.col("p").getField(n)
    text = F.coalesce(c("dc:description"), F.lit(""))
    return _papers(r, title=c("dc:title"), author=c("dc:creator"), year=F.regexp_extract(c("prism:coverDate"), r"\d{4}", 0), journal=c("prism:publicationName"), doi=c("prism:doi"), citation_count=c("citedby-count"), text=text, text_source=F.when(text != "", "abstract").otherwise("unknown"))


def encyclopedia_hits(answers: DataFrame, most: int = 20) -> DataFrame:
    """(page_id, title, year, place) of a search's answers (json), the first ``most`` of each."""
    hits = answers.select(F.posexplode(F.slice(F.from_json("json", HITS_JSON)["query"]["search"], 1, most)).alias("i", "p"))
    return hits.where("p.pageid is not null").select(F.col("p.pageid").alias("page_id"), "p.title", F.split("p.timestamp", "-")[0].try_cast("int").alias("year"), F.col("i").alias("place"))


def from_encyclopedia(answers: DataFrame) -> DataFrame:
    """(page_id, title, text) of an encyclopedia's answers (json), without tags."""
    pages = answers.select(F.explode(F.from_json("json", ENCYCLOPEDIA_JSON)["query"]["pages"]).alias("k", "p"))
    text = F.regexp_replace(F.regexp_replace("p.extract", r"<[^>]*>", ""), r"^\s+|\s+$", "")
    return pages.select(F.col("p.pageid").alias("page_id"), "p.title", text.alias("text"))


def found_ids(answers: DataFrame, most: int) -> DataFrame:
    """(search, pmid, place) of saved pages of id searches (search, page, json): each id once, at
    its first place, at most ``most`` (1 to 500) a search."""
    ids = answers.select("search", "page", F.posexplode(F.from_json("json", IDS_JSON)["esearchresult"]["idlist"]).alias("i", "pmid"))
    first = ids.groupBy("search", "pmid").agg(F.min(F.struct("page", "i")).alias("at"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy("at")) - 1)
    return ranked.where(F.col("place") < min(max(most, 1), 500)).select("search", "pmid", "place")


def id_batches(ids: DataFrame, size: int = 40) -> DataFrame:
    """(search, batch, pmids): ids in comma-joined groups, as records are asked for."""
    batch = F.floor(F.col("place") / size).cast("int").alias("batch")
    groups = ids.groupBy("search", batch).agg(F.sort_array(F.collect_list(F.struct("place", "pmid"))).alias("rows"))
    return groups.select("search", "batch", F.array_join("rows.pmid", ",").alias("pmids"))


def from_citations(answers: DataFrame) -> DataFrame:
    """(pmid, cited) of saved citation answers (json), whichever of its names the count has."""
    rows = answers.select(F.explode(F.from_json("json", CITED_JSON)["data"]).alias("p"))
    cited = F.coalesce(*[F.col("p")[c].try_cast("int") for c in ("citation_count", "citedByPmidCount", "citedbyPmidCount")])
    rows = rows.select(F.trim(F.col("p")["pmid"]).alias("pmid"), cited.alias("cited"))
    return rows.where("pmid <> '' and cited >= 0")


def _text(node: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(node.itertext())).strip() if node is not None else ""


def _article_ids(info: ET.Element, data: ET.Element | None) -> tuple[str, str]:
    """DOI and archive id: locations first, then the article's and the record's own lists; never
    those of the works that the article cites."""
    found = {"doi": "", "pmc": ""}
    for x in info.iterfind("ELocationID"):
        if (x.get("EIdType") or "").lower() == "doi":
            found["doi"] = found["doi"] or _text(x)
    for x in [*info.iterfind("ArticleIdList/ArticleId"), *(data.iterfind("ArticleIdList/ArticleId") if data is not None else ())]:
        kind = (x.get("IdType") or "").lower()
        if kind in found:
            found[kind] = found[kind] or _text(x)
    pmc = found["pmc"]
    return re.sub(r"(?i)^doi:", "", found["doi"]).strip(), pmc.upper() if pmc.upper().startswith("PMC") else pmc and f"PMC{pmc}"


def _first_author(info: ET.Element) -> str:
    """A group's name, a last name or initials of the first author."""
    first = info.find("AuthorList/Author")
    if first is None:
        return "Unknown"
    names = [_text(first.find(k)) for k in ("CollectiveName", "LastName", "Initials")]
    return next((x for x in [*names, (first.text or "").strip()] if x), "Unknown")


def _year(date: ET.Element | None) -> int:
    """The year of a date or of a range of dates, 0 if there is none."""
    if date is None:
        return 0
    m = re.match(r"\d+", _text(date.find("Year"))) or re.search(r"\d{4}", _text(date.find("MedlineDate")))
    return int(m[0]) if m else 0


def parse_pubmed(xml: str | None) -> list[tuple]:
    """Papers of a set of article records; what isn't known is ``Untitled``, ``Unknown`` or 0."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for a in root.iter("PubmedArticle"):
        cite, data = a.find("MedlineCitation"), a.find("PubmedData")
        info = cite.find("Article") if cite is not None else None
        info = ET.Element("Article") if info is None else info
        doi, pmcid = _article_ids(info, data)
        parts = [f"{label.upper()}: {t}" if (label := (x.get("Label") or "").strip()) else t for x in info.iterfind("Abstract/AbstractText") if (t := _text(x))]
        text = "\n\n".join(parts)
        pmid = _text(cite.find("PMID")) if cite is not None else ""
        out.append((_text(info.find("ArticleTitle")) or "Untitled", _first_author(info), _year(info.find("Journal/JournalIssue/PubDate")), _text(info.find("Journal/Title")) or "Unknown", doi or None, 0, text, pmid or None, pmcid or None, "abstract" if text else "unknown"))
    return out


def parse_fulltext(xml: str | None) -> str:
    """An article's body: titles in capitals, paragraphs, bullets; a blank line after each stretch."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return ""
    out: list[str] = []

    def read(node: ET.Element) -> str:
        parts = [node.text or ""]
        for child in node:
            parts += ["" if child.tag in UNREAD else read(child), child.tail or ""]
        return re.sub(r"\s+", " ", "".join(parts))

    def walk(node: ET.Element) -> None:
        for child in node:
            if child.tag in UNREAD:
                continue
            if child.tag == "title":
                out.append(read(child).strip().upper())
            elif child.tag == "p":
                out.append(read(child).strip())
            elif child.tag == "list":
                out.extend(f"• {read(item).strip()}" for item in child)
            else:
                walk(child)
                continue
            out.append("")

    for body in root.iter("body"):
        walk(body)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def from_pubmed(answers: DataFrame) -> DataFrame:
    """Papers of saved article sets (xml), parsed on the executors."""
    kinds = [pa.int32() if c in ("year", "citation_count") else pa.string() for c in PAPER_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in b.column(0) for r in parse_pubmed(x.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=list(PAPER_COLUMNS))

    return answers.select("xml").mapInArrow(run, ", ".join(f"{c} {'int' if c in ('year', 'citation_count') else 'string'}" for c in PAPER_COLUMNS))


def full_texts(answers: DataFrame) -> DataFrame:
    """(pmcid, text) of saved articles (pmcid, xml)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_fulltext(x.as_py()) for x in b.column(1)], pa.string())], names=["pmcid", "text"])

    return answers.select("pmcid", "xml").mapInArrow(run, "pmcid string, text string")


def with_citations(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Citation counts of a map (pmid, cited) where they aren't negative."""
    found = citations.where("cited >= 0").groupBy("pmid").agg(F.max("cited").alias("_cited"))
    return papers.join(found, "pmid", "left").withColumn("citation_count", F.coalesce("_cited", "citation_count")).drop("_cited")


def prompt_library(spark, path: str) -> dict[str, str]:
    """A small CSV of prompts (label, value, ...), quoted and multi-line, as a dictionary."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select("label", "value").collect()
    return {r["label"]: r["value"] for r in rows}

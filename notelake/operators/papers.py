"""Literature: keys, deduplication, scoring, budgets, formatted references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import token_estimate
from notelake.operators.rag import budgeted


def paper_key() -> Column:
    """The DOI, else the PubMed id, else title and year."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(filled("doi"))), F.concat(F.lit("pmid:"), filled("pmid")), F.concat(F.lit("title:"), F.coalesce(F.lower(F.trim("title")), F.lit("unknown-title")), F.lit("-"), F.coalesce(F.col("year").cast("string"), F.lit("0"))))


def dedupe(papers: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first paper of each key."""
    rows = papers.withColumn("key", paper_key())
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("_n = 1").drop("_n")


def relevance(position: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - position / F.greatest(F.lit(1), n))


def prioritize(papers: DataFrame, weights: tuple[float, float, float] = (50, 30, 20), *, pin_best: bool = True, jitter_seed: int | None = None) -> DataFrame:
    """Adds ``selection_score`` and ``place`` (from 1) to (paper_id, relevance_score, citation_count,
    full_text_available).

    Relevance, log citations (over the largest) and full text are weighted and summed; the best
    by each of the three come first, in this order.
    """
    share = max(1.0, float(sum(weights)))
    w = [x / share for x in weights]
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("relevance_score"), F.lit(0.0))))
    cit = F.log1p(F.greatest(F.lit(0), F.coalesce("citation_count", F.lit(0))).cast("double"))
    most = papers.agg(F.max(cit).alias("_most"))
    rows = papers.crossJoin(F.broadcast(most))  # one row
    rows = rows.withColumn("_r", rel).withColumn("_c", F.when(F.col("_most") > 0, cit / F.col("_most")).otherwise(F.lit(0.0))).withColumn("_f", F.coalesce(F.col("full_text_available").cast("int"), F.lit(0)).cast("double"))
    score = F.col("_r") * w[0] + F.col("_c") * w[1] + F.col("_f") * w[2]
    if jitter_seed is not None:
        score = score + F.rand(jitter_seed) * 0.01
    rows = rows.withColumn("selection_score", score)
    order = [F.desc("selection_score"), F.col("paper_id")]
    if pin_best:
        best = [rows.orderBy(F.desc(c), *order).limit(1).select("paper_id", F.lit(i).alias("_pin")) for i, c in enumerate(("_r", "_c", "_f"))]
        pins = best[0].union(best[1]).union(best[2]).groupBy("paper_id").agg(F.min("_pin").alias("_pin"))
        rows = rows.join(F.broadcast(pins), "paper_id", "left")
        order = [F.col("_pin").asc_nulls_last(), *order]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_r", "_c", "_f", "_most", "_pin")


def within_budget(papers: DataFrame, most: int, cost: Column) -> DataFrame:
    """Papers with a summary, in order, up to the first that passes the token budget."""
    return budgeted(papers.where(F.trim(F.coalesce("summary", F.lit(""))) != ""), most, cost=cost, order=["place"], least=1)


def within_excerpts(pages: DataFrame, most_tokens: int, used: int, *, share: float = 0.9) -> DataFrame:
    """Pages with an excerpt, by place, that fit what ``used`` tokens leave of a share of the window."""
    filled = pages.where(F.coalesce("excerpt", F.lit("")) != "")
    return budgeted(filled, int(share * most_tokens) - used, cost=token_estimate("excerpt"), order=["place"], least=1)


def first_text(*columns: str) -> Column:
    """The first source that has a text."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns])


def citation_line() -> Column:
    """A reference in one line; an author or journal that isn't known leaves no gap."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    known = lambda n, after: F.when(c(n) != "", F.concat(c(n), F.lit(after))).otherwise("")
    return F.concat(F.lit("- "), known("author", " "), F.lit("et al., ["), c("title"), F.lit("](https://doi.org/"), c("doi"), F.lit("), "), known("journal", ", "), c("year"), F.lit(", cited: "), c("citation_count"), F.lit("."))


def parse_plan(answer: Column) -> Column:
    """struct(questions, queries) of an answer with headed sections of questions and of queries.

    Each line of the second section is a query after its number or bullet."""
    parts = F.split(answer, r"(?i)# Research questions|# Queries")
    part = lambda i: F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")), r"^\s+|\s+$", "")
    lines = F.filter(F.split(part(3), "\n"), lambda x: x != "")
    return F.struct(part(2).alias("questions"), F.transform(lines, lambda x: F.regexp_replace(x, r"^[^ ]* ", "")).alias("queries"))


def select_tags(answer: Column, bank: Column, existing: Column, *, most: int = 5, keep_existing: bool = False) -> Column:
    """Tags of a comma-separated answer that the bank knows, at most so many, in answer order."""
    said = F.transform(F.split(answer, ","), lambda x: F.lower(F.trim(x)))
    known = F.slice(F.array_distinct(F.filter(said, lambda x: F.array_contains(bank, x))), 1, most)
    return F.array_union(existing, known) if keep_existing else known

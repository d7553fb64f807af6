"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import rag as R
from notelake.plans.base import query
from notelake.storage import table

_C = "c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'user' ELSE role END AS role, CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN '  ' ELSE text END AS text FROM conversations)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with some roles repeated and some messages blank."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "user").otherwise(F.col("role")).alias("role"), F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 == 0, "  ").otherwise(F.col("text")).alias("text"))


@query(
    f"""WITH {_C}, k AS (SELECT * FROM c WHERE role = 'system' OR trim(text) <> ''), f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS change FROM k),
i AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, min(turn) AS turn, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS hash FROM i GROUP BY conv_id, island"""
)
def chat_collapse_roles(spark: SparkSession, d: str) -> DataFrame:
    return R.collapse_roles(turns(spark, d)).select("conv_id", F.col("island").cast("long").alias("island"), "role", "turn", F.md5("text").alias("hash"))


@query(f"WITH {_C} SELECT conv_id, turn, n AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM c WHERE role = 'user') WHERE n <= 2")
def chat_last_user_turns(spark: SparkSession, d: str) -> DataFrame:
    return R.last_user_turns(turns(spark, d), 2).select("conv_id", "turn", F.col("back").cast("long").alias("back"))


@query(
    f"""WITH {_C}, n AS (SELECT *, length(text) AS n FROM c), t AS (SELECT *, floor(sum(n) OVER (PARTITION BY conv_id) * 0.4e0) AS budget, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS reach, turn = min(turn) OVER (PARTITION BY conv_id) AS first FROM n),
k AS (SELECT conv_id, turn, first, CASE WHEN first OR reach <= budget THEN text ELSE right(text, CAST(greatest(0, budget - (reach - n)) AS BIGINT)) END AS text FROM t)
SELECT conv_id, turn, md5(text) AS hash FROM k WHERE first OR text <> ''"""
)
def chat_suffix_select(spark: SparkSession, d: str) -> DataFrame:
    return R.select_suffix(turns(spark, d), 0.4).select("conv_id", "turn", F.md5("text").alias("hash"))


@query(f"WITH {_C} SELECT conv_id, turn, CASE WHEN lower(role) = 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM c WHERE trim(text) <> ''")
def history_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return R.sanitize_history(turns(spark, d)).select("conv_id", "turn", "role")


_CMD = "'Search: one' || chr(10) || replace(text, chr(10), ' ') || chr(10) || 'search:  two ' || turn || chr(10) || 'Notes: ' || md5(text) || ', x' || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Not context: zzz' ELSE '' END"


@query("SELECT conv_id, turn, 'two ' || turn AS search, md5(text) AS note, CAST(NULL AS VARCHAR) AS context, CASE WHEN turn % 2 = 0 THEN 'zzz' END AS not_context, trim(replace(text, chr(10), ' ')) AS rest FROM conversations")
def parse_commands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    head = F.replace("text", F.lit("\n"), F.lit(" "))
    t = F.concat(F.lit("Search: one\n"), head, F.lit("\nsearch:  two "), F.col("turn").cast("string"), F.lit("\nNotes: "), F.md5("text"), F.lit(", x"), F.when(F.col("turn") % 2 == 0, "\nNot context: zzz").otherwise(""))
    found = c.select("conv_id", "turn", R.parse_commands(t).alias("p"), R.without_commands(t).alias("rest"))
    return found.select("conv_id", "turn", "p.search", R.command_notes(F.col("p.notes"))[0].alias("note"), "p.context", "p.not_context", F.trim("rest").alias("rest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'mine ' || turn ELSE 'given' END AS search, md5(text) AS notes, CAST(NULL AS VARCHAR) AS context FROM conversations")
def effective_commands(spark: SparkSession, d: str) -> DataFrame:
    """Fenced defaults of a note, overridden by the last user turn."""
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("# Note\nContext: outside\n```settings\nSearch: old\nSearch: given\nNotes: "), F.md5("text"), F.lit("\n```\nend"))
    turn = F.concat(F.lit("Please.\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("search: mine "), F.col("turn").cast("string"))).otherwise(""))
    found = c.select("conv_id", "turn", R.effective_commands(body, turn).alias("p"))
    return found.select("conv_id", "turn", "p.search", "p.notes", "p.context")

"""Context assembly for retrieval-augmented prompts, and chat processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import matches_keywords, token_estimate


def neighbours(blocks: DataFrame, hits: DataFrame, *, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks of the hits' notes that are at most so many places before or after a hit by line.

    One window by note gives every block its place; the range join then is an equi-join on
    (note, place), since each hit asks for a known set of places.
    """
    place = F.row_number().over(Window.partitionBy("note_id").orderBy("line", *([c for c in ("block_no",) if c in blocks.columns])))
    placed = blocks.join(hits.select("note_id").distinct(), "note_id", "left_semi").withColumn("place", place)
    wanted = placed.join(hits.select("note_id", "line").distinct(), ["note_id", "line"], "left_semi")
    wanted = wanted.select("note_id", F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place")).distinct()
    return placed.join(wanted, ["note_id", "place"], "left_semi").drop("place")


def budgeted(ranked: DataFrame, budget: int, *, cost: Column, order: list[Column | str], per: list[str] | None = None, least: int = 0) -> DataFrame:
    """The longest prefix whose running cost stays within the budget (costs are positive).

    If every row costs ``least`` or more, only as many rows as could fit meet in one task."""
    if least and not per:
        ranked = ranked.orderBy(*order).limit(max(0, budget) // least + 1)
    w = (Window.partitionBy(*per) if per else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("cost", cost).withColumn("running", F.sum("cost").over(w)).where(F.col("running") <= budget)


def context(ranked: DataFrame, budget: int, *, keywords: str | None = None, overhead: int = 20) -> DataFrame:
    """Blocks (note_id, line, rank, title, heading, text) that fit, with citation numbers.

    In order of relevance up to the first overflow; then by note in first-seen order and by line.
    Each change of heading inside a note takes the next number.
    """
    named = F.when(F.col("heading") != F.col("title"), F.concat_ws(" ::: ", "title", "heading")).otherwise(F.col("title"))
    kept = ranked.where("text is not null").withColumn("shown", named)
    if keywords:
        kept = kept.where(matches_keywords(F.concat_ws("\n", "title", "text"), keywords))
    kept = budgeted(kept, budget, cost=token_estimate("text") + overhead, order=["rank"], least=overhead)
    kept = kept.withColumn("seen", F.min("rank").over(Window.partitionBy("note_id")))
    order = Window.orderBy("seen", "note_id", "line", "rank")
    fresh = (F.coalesce(F.lag("note_id").over(order) != F.col("note_id"), F.lit(True)) | F.coalesce(F.lag("shown").over(order) != F.col("shown"), F.lit(True))).cast("int")
    kept = kept.withColumn("fresh", fresh)
    return kept.withColumn("citation", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))


def context_text(assembled: DataFrame) -> DataFrame:
    """One row (context, citations) from an assembled context."""
    line = F.concat(F.lit("# note "), F.col("citation").cast("string"), F.lit(": "), F.col("shown"), F.lit("\n"), F.col("text"))
    return assembled.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("fresh") == 1, F.struct("citation", "note_id", "line")))), lambda x: x).alias("citations"),
    )


def sanitize_history(turns: DataFrame) -> DataFrame:
    """Roles other than assistant become user; blank messages go."""
    return turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("role", F.when(F.lower("role") == "assistant", "assistant").otherwise("user"))


def collapse_roles(turns: DataFrame) -> DataFrame:
    """Adjacent turns of one role in a conversation become one, joined by a blank line."""
    turns = turns.where((F.col("role") == "system") | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))
    grouped = turns.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return grouped.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.min("turn").alias("turn"), F.array_join(texts, "\n\n").alias("text"))


def last_user_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.where("role = 'user'").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def select_suffix(turns: DataFrame, fraction: float) -> DataFrame:
    """The last messages up to a fraction of all characters; the next one keeps its tail.

    A conversation's first message always stays whole."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    n = F.length(F.coalesce("text", F.lit("")))
    t = turns.withColumn("n", n).withColumn("budget", F.floor(F.sum("n").over(whole) * F.lit(fraction))).withColumn("reach", F.sum("n").over(back))
    t = t.withColumn("first", F.min("turn").over(whole) == F.col("turn"))
    left = F.greatest(F.lit(0), F.col("budget") - (F.col("reach") - F.col("n"))).cast("int")
    kept = F.when(F.col("first") | (F.col("reach") <= F.col("budget")), F.col("text")).otherwise(F.right("text", left))
    return t.withColumn("text", kept).where("first or (text is not null and text <> '')").drop("n", "budget", "reach", "first")


def parse_commands(t: Column | str, names: tuple[str, ...] = ("search", "notes", "context", "not context")) -> Column:
    """A struct of the last ``Name: value`` line of each command in a text (null where none)."""
    t = t if isinstance(t, Column) else F.col(t)

    def last(name: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(?im)^{name}:[ \t]*(\S[^\n]*)$"), F.lit(1))
        return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))

    return F.struct(*[last(n).alias(n.replace(" ", "_")) for n in names])


def command_notes(t: Column) -> Column:
    """Note ids (32 letters and digits) of a ``Notes:`` command."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?<![A-Za-z0-9])([A-Za-z0-9]{32})(?![A-Za-z0-9])"), F.lit(1)))


def without_commands(t: Column | str, names: tuple[str, ...] = ("search", "notes", "context", "not context")) -> Column:
    t = t if isinstance(t, Column) else F.col(t)
    rest = F.regexp_replace(t, rf"(?im)^(?:{'|'.join(names)}):[^\n]*\n?", "")
    return F.regexp_replace(rest, r"^\s+|\s+$", "")


def global_commands(body: Column | str, names: tuple[str, ...] = ("search", "notes", "context", "not context")) -> Column:
    """The last ``name: value`` line of each command inside fenced blocks of a note."""
    body = body if isinstance(body, Column) else F.col(body)
    fenced = F.array_join(F.regexp_extract_all(body, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1)), "\n")
    return parse_commands(fenced, names)


def effective_commands(body: Column | str, last_turn: Column | str, names: tuple[str, ...] = ("search", "notes", "context", "not context")) -> Column:
    """Commands of the last user turn; what it lacks comes from the note's fenced defaults."""
    own, given = parse_commands(last_turn, names), global_commands(body, names)
    keys = [n.replace(" ", "_") for n in names]
    return F.struct(*[F.coalesce(own[k], given[k]).alias(k) for k in keys])


def parse_chat(text: str, *, user: str = "User:", model: str = "Assistant:", system: list[str] = ()) -> list[tuple[str, str]]:
    """(role, content) of a chat kept as text; lines ``===`` fence stretches without markers."""
    out: list[list[str]] = [["system", s] for s in system]
    role, held, fenced, marked = "user", [], False, False
    entries: list[list[str]] = []

    def close() -> None:
        content = "\n".join(held).strip()
        if content.endswith("---"):
            content = content[:-3].strip()
        if content:
            entries.append([role, content])

    for line in text.split("\n"):
        if line.strip() == "===":
            fenced = not fenced
        hit = next(((r, m) for r, m in (("user", user), ("assistant", model)) if not fenced and line.startswith(m)), None)
        if hit is None:
            held.append(line)
            continue
        close()
        if not marked and hit[0] == "user" and entries:
            entries[0][0] = "assistant"
        marked, role, held = True, hit[0], [line[len(hit[1]) :]]
    close()
    for r, content in entries:
        if out and out[-1][0] == r:
            out[-1][1] += "\n\n" + content
        else:
            out.append([r, content])
    return [tuple(x) for x in out]

"""Structure-aware chunking of notes under a token budget.

Three steps: a body is cut at fenced code and heading lines; headings are carried forward as a
path; pieces are packed greedily from sentences (or lines of code). The fold is sequential by
nature, so one UDTF-like ``mapInArrow`` pass does it per note; nothing is shuffled.

Decisions: a heading clears the deeper levels of the path unless ``keep_stale_path``; empty
chunks are dropped; offsets are tracked through the fold rather than looked up; heading lines
are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from notelake.functions.text import CJK, MARKS, SENTENCE

MAX_LEVEL = 6
_STRUCTURE = re.compile(r"(^```.*?```$|^#+\s[^\n]*)", re.M | re.S)
_SENTENCE = re.compile(SENTENCE)
_CJK, _MARK = re.compile(CJK), re.compile(MARKS)
CHUNK_DDL = "note_id string, block_no int, line int, body_idx int, length int, level int, title string, path array<string>, chunk string, decorated string"


def estimate(t: str) -> int:
    """The token estimate of ``functions.text.token_estimate``, in Python."""
    if not t:
        return 0
    per = 2.5 if _CJK.search(t) else 3.2 if not t.isascii() else 3.5 if len(_MARK.findall(t)) / len(t) > 0.1 else 4.0
    return math.ceil(len(t) / per)


@dataclass(frozen=True)
class Options:
    max_tokens: int = 512
    embed_title: bool = True
    embed_path: bool = True
    embed_heading: bool = True
    embed_tags: bool = True
    include_code: bool = False
    keep_stale_path: bool = False


def truncated(t: str, most: int, suffix: str = " [truncated]") -> str:
    n = estimate(t)
    return t if n <= most else t[: max(0, math.floor((most - estimate(suffix)) * len(t) / n * 0.95))] + suffix


def pack(segments: list[tuple[int, str]], most: int) -> list[tuple[int, str]]:
    """Greedy: a segment is appended while the estimate stays within ``most``."""
    out: list[tuple[int, str]] = []
    start, held, size = 0, "", 0
    for at, s in segments:
        n = estimate(s)
        if held and size + n <= most:
            held, size = held + s, size + n
            continue
        if held:
            out.append((start, held))
        start, held = at, s if n <= most else truncated(s, most)
        size = n if n <= most else estimate(held)
    return [*out, (start, held)] if held else out


def chunks(title: str, body: str, tags: list[str], options: Options) -> Iterator[tuple]:
    """(line, offset, length, level, heading, path, text, decorated) of a note's chunks."""
    body = re.sub(r"\r\n?", "\n", body)
    level, heading, path = 0, title, [title] + [""] * MAX_LEVEL
    at, line, counted = 0, 1, 0
    for piece in _STRUCTURE.split(body):
        here, at = at, at + len(piece)
        if not piece.strip():
            continue
        code = piece.startswith("```")
        if code and not options.include_code:
            continue
        if code:
            heading = f"{piece[3:].partition(chr(10))[0].strip('` ')} code block".strip()
            path[level] = heading if level else path[0]
            segments, pos = [], here
            for text in piece.split("\n"):
                segments.append((pos, text + "\n"))
                pos += len(text) + 1
        elif m := re.match(r"(#+)\s(.*)", piece):
            level, heading = min(len(m[1]), MAX_LEVEL), m[2].strip()
            path[level] = heading
            if not options.keep_stale_path:
                path[level + 1 :] = [""] * (MAX_LEVEL - level)
            continue
        else:
            segments = [(here + s.start(), s[0]) for s in _SENTENCE.finditer(piece + "\n")] or [(here, piece)]
        for offset, text in pack(segments, options.max_tokens):
            if not text.strip():
                continue
            shown = path[(0 if options.embed_title else 1) : (level if options.embed_path and level else 1)]
            shown += [path[level]] if options.embed_heading else []
            head = "/".join(x for x in shown if x)
            head = f"{head}:\n" if head else ""
            head += f"tags: {', '.join(tags)}\n" if options.embed_tags and tags else ""
            line, counted = line + body.count("\n", counted, offset), offset
            yield line, offset, len(text), level, heading, [x for x in path[: level + 1] if x], text, head + text


def chunk_notes(notes: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks of notes (note_id, title, body, tags: array)."""
    schema = pa.schema([("note_id", pa.string()), *((c, pa.int32()) for c in ("block_no", "line", "body_idx", "length", "level")), ("title", pa.string()), ("path", pa.list_(pa.string())), ("chunk", pa.string()), ("decorated", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for note, title, body, tags in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(note, i, *c) for i, c in enumerate(chunks(title or "", body or "", tags or [], options))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return notes.select(F.col("note_id").cast("string"), "title", "body", F.col("tags").cast("array<string>")).mapInArrow(run, CHUNK_DDL)


def pack_sentences(segments: Column, most: int, cost: Column | None = None) -> Column:
    """The greedy packing in the JVM; segments led by ``#`` are skipped.

    Each segment is measured and cut once; a fold over the sizes alone says where chunks begin, and
    the chunks are slices of the array: no text is copied in the fold."""
    from notelake.functions.text import token_estimate, truncate_tokens

    kept = F.filter(segments, lambda x: ~x.startswith("#"))
    sized = F.transform(kept, lambda x: F.struct(x.alias("t"), token_estimate(x).alias("n")))

    def step(s: Column, x: Column) -> Column:
        fits = (s["size"] + x["n"] <= most) & (s["at"] > 0)
        starts = F.when(fits, s["starts"]).otherwise(F.array_append(s["starts"], s["at"]))
        return F.struct((s["at"] + 1).alias("at"), F.when(fits, s["size"] + x["n"]).otherwise(x["alone"]).alias("size"), starts.alias("starts"))

    def cut(p: Column) -> Column:
        """Segments that are too long cut; ``bind`` evaluates a value once for all its uses."""
        short = lambda x: F.when(x["n"] <= most, x["t"]).otherwise(truncate_tokens(x["t"], most))
        return bind(F.transform(p, lambda x: F.struct(x["n"].alias("n"), short(x).alias("t"))), slices)

    def slices(p: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))
        sizes = F.transform(p, lambda x: F.struct(x["n"].alias("n"), F.when(x["n"] <= most, x["n"]).otherwise(token_estimate(x["t"])).alias("alone")))
        made = F.struct(F.transform(p, lambda x: x["t"]).alias("cut"), F.aggregate(sizes, begin, step, lambda s: s["starts"]).alias("starts"))
        return bind(made, lambda s: F.transform(s["starts"], lambda a, i: F.array_join(F.slice(s["cut"], a + 1, F.coalesce(F.get(s["starts"], i + 1), F.size(s["cut"])) - a), "")))

    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    return bind(sized, cut)


def split_rows(df: DataFrame, parts: str, most: int, *, prefer: str = "first", separator: str = " ") -> DataFrame:
    """``split_by_tokens`` of an array column: adds ``rows``, an array of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [split_by_tokens([x or "" for x in p or []], most, prefer=prefer, separator=separator) for p in b.column(b.schema.get_field_index(parts)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.list_(pa.string())))], names=[*b.schema.names, "rows"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("rows", ArrayType(ArrayType(StringType())))]))


def split_by_tokens(parts: list[str], most: int, *, prefer: str = "first", separator: str = " ") -> list[list[str]]:
    """Parts over the budget are halved until they fit; all are packed into rows in order.

    With ``prefer='last'`` the packing starts from the end and keeps each row's order."""

    def halves(p: str) -> list[str]:
        if estimate(p) <= most or len(p) < 2:
            return [p]
        words = p.split(separator)
        if len(words) > 1:
            m = len(words) // 2
            a, b = separator.join(words[:m]), separator.join(words[m:])
        else:
            a, b = p[: len(p) // 2], p[len(p) // 2 :]
        return halves(a) + halves(b)

    small = [h for p in parts for h in halves(p)]
    rows: list[list[str]] = [[]]
    size = 0
    for p in small if prefer == "first" else reversed(small):
        n = estimate(p)
        if rows[-1] and size + n > most:
            rows.append([])
            size = 0
        rows[-1].append(p)
        size += n
    return rows if prefer == "first" else [r[::-1] for r in rows]

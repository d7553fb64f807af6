"""License scans: exact phrases and a fuzzy search for short notices.

Texts are lower-cased (A-Z) and cut into words of letters and digits; words are joined by one
blank, so punctuation and line breaks don't matter. A notice of m characters may differ in
``m // 10`` edits. It is cut into one piece more than that, so that one piece must be there
unchanged (pigeonhole); all pieces are found by one Aho-Corasick pass, and the windows around
them are verified by bounded-error matching, which also gives the edits. The best match of a
window is taken first, then the best ones before and after it, until none is left.

Matching is on whole texts. Edge cases: null and empty texts have no words, no labels and score
0; very long texts are read whole; notices that run into each other are reported each; of equally
good matches in a window the first is taken first; repeated rows and null ids are scanned
one by one; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.words import slices
from notelake.storage import table

#: Base phrases and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices and their labels. Wording of public licenses.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "creative commons zero": "cc0",
    "gnu free documentation license": "gfdl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this software is provided by the copyright holders and contributors as is": "bsd",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "boost software license version 1 0": "bsl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "academic free license": "afl",
    "microsoft public license": "ms-pl",
    "sil open font license": "ofl",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

_SEPARATORS = bytes(i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
_NORMAL = bytes(0x20 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Match:
    """A notice: words ``first`` to ``last`` (inclusive), code points ``start`` to ``end``."""

    label: str
    notice: str
    first: int
    last: int
    edits: int
    start: int = -1
    end: int = -1


class Searcher:
    def __init__(self, notices: dict[str, str] = NOTICES):
        self.notices = list(notices.items())
        self.edits = [len(n) // CHARS_PER_EDIT for n, _ in self.notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for (n, _), k in zip(self.notices, self.edits, strict=True)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((notice, _), k) in enumerate(zip(self.notices, self.edits, strict=True)):
            cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((i, a))
        self.machine = ahocorasick.Automaton()
        for piece, at in seeds.items():
            self.machine.add_word(piece, (len(piece), at))
        self.machine.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Merged stretches of the normal text where each notice could be."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, at) in self.machine.iter(text):
            for i, offset in at:
                k, a = self.edits[i], end - size + 1 - offset
                lo, hi = max(0, a - k), min(len(text), a + len(self.notices[i][0]) + k)
                spans = found.setdefault(i, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        return found

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a normal text whose words are joined by one blank."""
        out = []
        for i, spans in self.windows(text).items():
            while spans:
                lo, hi = spans.pop()
                m = self.patterns[i].search(text, lo, hi)
                if m:  # the best of the window, which may have others on both sides
                    out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    spans += [(a, b) for a, b in ((lo, m.start()), (m.end(), hi)) if b - a >= len(self.notices[i][0]) - self.edits[i]]
        return sorted(set(out))


_searcher: list[Searcher] = []


def searcher() -> Searcher:
    if not _searcher:
        _searcher.append(Searcher())
    return _searcher[0]


def _joined(text: str | None) -> str:
    """The normal text as one character for each byte (pieces and notices are ASCII)."""
    raw = (text or "").encode("utf-8", "replace").translate(_NORMAL)
    return b" ".join(raw.split()).decode("latin-1") if raw else ""


def notices(text: str | None) -> list[Match]:
    """All notices of a text, with the words and the code points they span."""
    joined = _joined(text)
    found = searcher().search(joined)
    if not found:
        return []
    words = list(_WORD.finditer(text or ""))
    out = []
    for i, start, end, edits in found:
        first, last = joined.count(" ", 0, start + (joined[start : start + 1] == " ")), joined.count(" ", 0, max(start + 1, end - (joined[end - 1 : end] == " ")))
        out.append(Match(searcher().notices[i][1], searcher().notices[i][0], first, last, edits, words[first].start(), words[min(last, len(words) - 1)].end()))
    return out


def base_places(joined: str) -> list[tuple[int, str]]:
    """(word index, label) of each place where a base phrase's words stand."""
    out, framed = [], f" {joined} "
    for phrase, label in PHRASES.items():
        at = framed.find(f" {phrase} ")
        while at >= 0:
            out.append((framed.count(" ", 0, at), label))
            at = framed.find(f" {phrase} ", at + 1)
    return sorted(out)


def _row(text: str | None) -> tuple[int, int | None, int | None, str, str, float]:
    joined = _joined(text)
    base = base_places(joined)
    fuzzy = searcher().search(joined)
    labels = {x for _, x in base}
    more = labels | {searcher().notices[i][1] for i, _, _, _ in fuzzy}
    best = max((1 - e / len(searcher().notices[i][0]) for i, _, _, e in fuzzy), default=0.0)
    return len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if base else max(0.0, best)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            counts = np.concatenate([s.counts() for s in slices(column, separators=_SEPARATORS)] or [np.empty(0, np.int64)]).astype(np.int64)
            rows, spans = [], []
            for t in column:
                text = t.as_py()
                rows.append(_row(text))
                spans.append(",".join(f"{m.label}:{m.start}:{m.end}:{m.edits}" for m in notices(text)) if rows[-1][4] else "")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), pa.array(spans, pa.string())], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op10_license_scan``, which SQL can express."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
p AS (SELECT unnest({list(PHRASES)}) AS phrase, unnest({list(PHRASES.values())}) AS label),
x AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d),
places AS (SELECT r, label, i FROM x JOIN p ON x = string_split(phrase, ' ')[1] JOIN d USING (r) WHERE array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase),
found AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (r)
"""

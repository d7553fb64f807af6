"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin, turns digits and signs
that stand in for letters into those letters and everything else into blanks. The lexicon is
learned: whole words and word beginnings that labelled toxic documents hold far more often than
clean ones, weighted by the log ratio. Exception phrases (a term with the word after it, that
clean documents hold) silence a term. A document's two figures, the weights summed per word and
that sum by length, go through a logistic curve, fitted on the same sample.

The lexicon and the curve are fitted on at most ``FIT_ROWS`` labelled training documents, chosen by a
hash of the id; that bound is the only one on terms and exceptions. Every whole text is scored.

Edge cases: null and empty texts have no terms and get the score of a text without any; very long
texts are folded whole; of terms that begin at one place the weightiest counts, of equal ones the
shortest; without labelled rows of both kinds the lexicon is empty and all scores are 0; several
labels of an id count as toxic if one is, of several texts of an id the least is learned from; null ids and null labels are never learned from; a null id counts as
not held out; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.language_id import split
from notelake.llm.quality_forest import sampled
from notelake.storage import materialize, table

FIT_ROWS = 20_000
#: Least toxic documents that hold a term; least log ratio of a term.
LEAST_ROWS, LEAST_WEIGHT = 4, 4.0
#: Lengths of word beginnings that can be terms.
BEGINNINGS = (4, 5, 6, 7)
#: Log ratio from which a term is looked at with its exceptions; clean documents that must hold
#: a phrase (and no toxic one) for it to be an exception.
LOOK_WEIGHT, EXCEPTION_ROWS = 1.0, 3
THRESHOLD = 0.7

#: Characters that are read as others. Common look-alikes and digit substitutions.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_UPPER_ALIKE = {"А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x"}
_FOLD = {i: " " for i in range(128) if not chr(i).isalnum()}
_FOLD |= {ord(c): " " for c in " ‘’“”–—…«»¿¡　"} | {ord(c): None for c in "­​‌‍⁠﻿"}
_FOLD |= {0xFF01 + i: chr(0x21 + i).lower() if chr(0x21 + i).isalnum() else " " for i in range(94)}
_FOLD |= {ord(k): v for k, v in (LOOK_ALIKES | _UPPER_ALIKE | DIGITS).items()}


def folded(text: str | None) -> str:
    """Folded words, one blank around each."""
    words = (text or "").translate(_FOLD).lower().split()
    return f" {' '.join(words)} " if words else ""


def terms(word: str) -> list[str]:
    """Terms a word could be found by: itself (with its blanks) and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: phrases (term, next word) that say nothing bad
    exceptions: frozenset[tuple[str, str]] = frozenset()
    #: intercept and slopes of the logistic curve
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    _machine: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._machine.add_word(term, (term, weight))
            self._machine.make_automaton()
        return self._machine

    def present(self, text: str) -> set[str]:
        """All terms of a folded text, exceptions left out."""
        found = ((term, end - len(term) + 1) for end, (term, _) in self.machine().iter(text)) if self.weights else ()
        return {t for t, at in found if not self.exceptions or (t, _next_word(text, at)) not in self.exceptions}

    def matches(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of a folded word to its weightiest term, exceptions left out."""
        best: dict[int, tuple[str, float]] = {}
        if not self.weights:
            return best
        for end, (term, weight) in self.machine().iter(text):
            start = end - len(term) + 1
            if weight > best.get(start, ("", 0.0))[1]:
                best[start] = (term, weight)
        if self.exceptions and best:
            best = {a: x for a, x in best.items() if (x[0], _next_word(text, a)) not in self.exceptions}
        return best

    def figures(self, text: str | None) -> tuple[float, float]:
        f = folded(text)
        total = sum(w for _, w in self.matches(f).values())
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(8, f.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        a, b = self.figures(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _next_word(text: str, start: int) -> str:
    stop = text.find(" ", start + 1)
    return text[stop + 1 : text.find(" ", stop + 1)] if 0 <= stop < len(text) - 1 else ""


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A ridge logistic fit by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-2, 1e-2])
        w += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * w)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fits lexicon, exceptions and curve on a bounded sample of labelled rows of ``docs``."""
    flags = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = sampled(docs.select("doc_id").join(flags, "doc_id").distinct(), FIT_ROWS, 0)
    # at most FIT_ROWS rows are broadcast; an id that stands in many rows gives one text
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(rows.select("text", "toxic"), "toxicity-sample")
    counts = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = (Counter(), Counter())
            for text, flag in zip(b.column(0), b.column(1), strict=True):
                by[flag.as_py() == 1].update({t for w in set(folded(text.as_py()).split()) for t in terms(w)})
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in by)], names=["term", "clean", "toxic"])

    total = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = total.withColumn("weight", weight).where((F.col("toxic") >= LEAST_ROWS) & (F.col("weight") >= LOOK_WEIGHT))
    looked = Lexicon({r["term"]: r["weight"] for r in found.collect()})
    if not looked.weights:
        return Lexicon()

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, int]] = []
            for text, flag in zip(b.column(0), b.column(1), strict=True):
                f = folded(text.as_py())
                pairs = {(t, _next_word(f, end - len(t) + 1)) for end, (t, _) in looked.machine().iter(f)}
                out += [(t, w, int(flag.as_py() == 1)) for t, w in pairs if w]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], names=["term", "following", "toxic"])

    seen = sample.mapInArrow(phrases, "term string, following string, toxic int").groupBy("term", "following").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    innocent = seen.where(f"clean >= {EXCEPTION_ROWS} and toxic = 0")
    looked.exceptions = frozenset((r["term"], r["following"]) for r in innocent.collect())

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = (Counter(), Counter())
            for text, flag in zip(b.column(0), b.column(1), strict=True):
                by[flag.as_py() == 1].update(looked.present(folded(text.as_py())))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in by)], names=["term", "clean", "toxic"])

    total = sample.mapInArrow(recount, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = total.withColumn("weight", weight).where((F.col("toxic") >= LEAST_ROWS) & (F.col("weight") >= LEAST_WEIGHT)).collect()
    lexicon = Lexicon({r["term"]: r["weight"] for r in kept})
    if not lexicon.weights:
        return lexicon
    lexicon.exceptions = frozenset(x for x in looked.exceptions if x[0] in lexicon.weights)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.figures(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1).cast(pa.int32())], names=["a", "b", "toxic"])

    x = sample.mapInArrow(figures, "a double, b double, toxic int").toPandas()
    x = x.sort_values(["a", "b", "toxic"])
    lexicon.curve = _logistic(x[["a", "b"]].to_numpy(), (x["toxic"] == 1).to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for rows of (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            scores = np.array([lexicon.score(t.as_py()) for t in b.column(2)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 1)
    return score(docs, learn(docs.where("not held_out"), table(spark, sf_dir, "labels")))

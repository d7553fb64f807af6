"""Language identification by rank-order profiles of character n-grams.

A profile is the ranking of the ``PROFILE`` most frequent n-grams (1 to 3 letters, words padded
with a blank on both sides). A document goes to the language whose profile has the least
out-of-place distance from its own: the sum over its n-grams of how many places apart the two
ranks are, or ``PROFILE`` where the language lacks the n-gram. Profiles are learned from counts
over all training documents, summed by Spark; only ``PROFILE`` rows a language go to the driver.

``score`` is 1 - distance / worst distance. Edge cases: null, empty and letterless texts are
``und`` with score 0, and so is everything where nothing could be learned; null languages are
never learned; very long texts are read whole; a null id counts as not held out; ties go to the code point order of the
languages; repeated rows are predicted alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.storage import table

PROFILE = 300
UNKNOWN = "und"
#: n-grams that are counted at once in training.
HELD = 4_000_000

_BMP = np.array([chr(i).isalpha() for i in range(0x10000)])
_BITS = np.int64(21)


def _codes(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers: 21 bits a letter, 0 for the blank around words."""
    if not text:
        return np.empty(0, np.int64)
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _BMP[np.minimum(x, 0xFFFF)]
    high = np.flatnonzero(x > 0xFFFF)
    if len(high):
        letter[high] = [chr(c).isalpha() for c in x[high]]
    if not letter.any():
        return np.empty(0, np.int64)
    x = np.concatenate([[0], np.where(letter, x, 0), [0]])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)  # one blank between words
    x = x[keep]
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    # single letters are under 2 ** 21, pairs are made negative, threes get bit 62 (letters are under 2 ** 20)
    return np.concatenate([x[x != 0], -two, three[x[1:-1] != 0] | np.int64(1 << 62)])


def ranking(text: str | None) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties by code."""
    codes = _codes(text)
    if not len(codes):
        return codes
    codes.sort()
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.append(edge, len(codes)))
    if len(count) > PROFILE:
        least = np.partition(count, len(count) - PROFILE)[len(count) - PROFILE]
        some = count >= least
        edge, count = edge[some], count[some]
    return codes[edge][np.argsort(-count, kind="stable")][:PROFILE]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray
    #: rank of each gram in each language (``PROFILE`` where it isn't in the profile)
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(text)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own
        off = np.abs(self.ranks[:, at] - np.arange(len(own)))
        missing = self.ranks[:, at] == PROFILE
        distance = np.where(known & ~missing, off, PROFILE).sum(axis=1)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(own)))


def learn(docs: DataFrame) -> Profiles:
    """Profiles from all rows of (text, lang) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                codes = _codes(text.as_py())
                held.setdefault(lang.as_py(), []).append(codes)
                size += len(codes)
                if size >= HELD:
                    yield from counts(held)
                    held, size = {}, 0
        yield from counts(held)

    def counts(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("place", place).where(F.col("place") <= PROFILE).toPandas()
    languages = sorted(top["lang"].unique().tolist())
    grams = np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(grams)), PROFILE)
    row = top["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    ranks[row, np.searchsorted(grams, top["gram"].to_numpy(np.int64))] = top["place"].to_numpy(np.int64) - 1
    return Profiles(languages, grams, ranks)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for rows of (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def split(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """Adds ``held_out``: crc32 of the id as text, modulo ``folds``, is ``held``."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 4, 2)
    return predict(docs, learn(docs.where("not held_out")))


def crc32_sql(text: str) -> str:
    """DuckDB: crc32 of an ASCII text, bit by bit."""
    step = "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ord({text}[i]) AS BIGINT))"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: list_reduce(list_prepend(xor(a, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), {step})))"


def held_out_sql(folds: int, held: int) -> str:
    """DuckDB: the column that ``split`` adds."""
    return f"coalesce({crc32_sql('CAST(doc_id AS VARCHAR)')} % {folds} = {held}, false)"


_ORD = "CASE WHEN {0}[{1}] = ' ' THEN 0 ELSE CAST(ord({0}[{1}]) AS BIGINT) END"
OP7_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, text, row_number() OVER () AS r, {held_out_sql(4, 2)} AS held_out FROM documents),
w AS (SELECT r, ' ' || unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) || ' ' AS w FROM d),
g AS (SELECT r, unnest(list_concat(list_transform(range(2, length(w)), lambda i: w[i]), list_transform(range(1, length(w)), lambda i: w[i:i+1]),
  list_transform(range(1, length(w) - 1), lambda i: w[i:i+2]))) AS gram FROM w),
n AS (SELECT r, gram, count(*) AS n FROM g GROUP BY ALL),
codes AS MATERIALIZED (SELECT gram, CASE length(gram) WHEN 1 THEN CAST(ord(gram) AS BIGINT)
  WHEN 2 THEN -(({_ORD.format('gram', 1)}) * 2097152 + ({_ORD.format('gram', 2)}))
  ELSE 4611686018427387904 + ({_ORD.format('gram', 1)}) * 4398046511104 + ({_ORD.format('gram', 2)}) * 2097152 + ({_ORD.format('gram', 3)}) END AS code
  FROM (SELECT DISTINCT gram FROM n)),
coded AS MATERIALIZED (SELECT r, code, n FROM n JOIN codes USING (gram)),
own AS MATERIALIZED (SELECT * FROM (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 AS place FROM coded) WHERE place < {PROFILE}),
learned AS (SELECT lang, code, sum(c.n) AS n FROM coded c JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL),
profile AS MATERIALIZED (SELECT * FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS place FROM learned) WHERE place < {PROFILE}),
langs AS (SELECT DISTINCT lang FROM profile),
apart AS (SELECT o.r, l.lang, sum(CASE WHEN p.place IS NULL THEN {PROFILE} ELSE abs(p.place - o.place) END) AS distance, count(*) AS size
  FROM own o CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.code = o.code GROUP BY ALL),
best AS (SELECT r, arg_min(lang, (distance, lang)) AS lang, min(distance) AS distance, min(size) AS size FROM apart GROUP BY r)
SELECT doc_id, held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred,
  CASE WHEN best.r IS NULL THEN 0 ELSE 1 - CAST(distance AS DOUBLE) / ({PROFILE} * size) END AS score
FROM d LEFT JOIN best USING (r)
"""

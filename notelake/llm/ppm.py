"""LM scoring: prediction by partial matching over bytes, and a unigram base.

The model is a byte-context trie of fixed depth with method C escapes and full symbol exclusion,
kept as sorted arrays of (context, symbol) codes for each order; texts are bracketed by a
boundary symbol. It is pretrained: all counts come from all training texts, summed by Spark.
Since a pretrained probability depends on the last bytes and the next symbol only, each distinct
byte gram of a slice of documents is scored once, vectorised, and summed per document.

Sizes. The trie's depth is ``ORDER`` at any size. An order of at most ``MAX_GRAMS`` entries (a bound
on what the driver gathers and a broadcast holds) is broadcast whole. Beyond that only contexts from
a count on are, with all their symbols; since a context's suffix is at least as frequent, the lower
orders of such a context are there, too. Document grams after any other context are shuffled once,
dealt with all training grams by the context's last two symbols, which hold all of orders 2 and up;
orders 0 and 1 have at most 257^2 entries. Word counts may be of any number: the ``HOT_WORDS`` most
frequent words at most are broadcast; the rest is joined by key, each document's rare words being
shuffled once.

Edge cases: null and empty texts have the end token only; very long texts are scored whole; words of
one count are hot or rare together; with nothing to train on, words have
count 0 (N = V = 0) and all symbols are equally likely; a null id counts as not held out; repeated
rows are scored one by one (and trained on each); words are told apart by a 64-bit hash; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.decontaminate import words_sql
from notelake.llm.language_id import held_out_sql, split
from notelake.llm.words import Slice, slices
from notelake.storage import materialize, table

ORDER, MAX_GRAMS, HOT_WORDS = 4, 4_000_000, 200_000
#: Distinct keys that a training task holds before it hands them on.
HELD = 4_000_000
BITS, BOUNDARY, SYMBOLS = 9, 256, 257
WORD, GRAM, TEXT = 0, 1, 2


def gram_codes(s: Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``order + 1`` symbols, one for each byte and each text's end; row offsets."""
    size, step = np.diff(s.row_bytes), order + 1
    row = np.repeat(np.arange(s.rows), size)
    symbols = np.full(len(s.data) + step * s.rows, BOUNDARY, np.uint64)
    symbols[np.arange(len(s.data)) + step * row + order] = s.data
    n = len(symbols) - order
    code = np.zeros(n, np.uint64)
    for k in range(step):
        np.left_shift(code, np.uint64(BITS), out=code)
        code |= symbols[k : n + k]
    at = s.row_bytes + np.arange(s.rows + 1)  # one more symbol a row than bytes
    keep = np.ones(n, bool)
    if order and s.rows > 1:
        cross = (s.row_bytes[1:-1] + step * np.arange(1, s.rows))[:, None] - np.arange(1, order + 1)
        keep[cross.ravel()] = False
    return code[keep], at


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, found = pd.factorize(key)
    return found, np.bincount(code, weights=n, minlength=len(found)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): counts of word hashes, of byte grams and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        texts = 0
        for b in batches:
            texts += len(b)
            for s in slices(b.column(0)):
                for kind, keys in ((WORD, s.hashes()), (GRAM, gram_codes(s, ORDER)[0])):
                    code, found = pd.factorize(keys)
                    held[kind].append((found, np.bincount(code, minlength=len(found))))
                    if len(held[kind]) >= 8:
                        held[kind] = [_sum(held[kind])]
                        if len(held[kind][0][0]) > HELD:
                            yield rows(kind, *held[kind][0])
                            held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield rows(kind, *_sum(parts))
        yield rows(TEXT, np.zeros(1, np.uint64), np.array([texts]))

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    made = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return materialize(made.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Level:
    """One order: sorted codes with counts, and its contexts with totals.

    ``lower`` is, for each context, the lower order's count of the symbols seen here."""

    code: np.ndarray
    n: np.ndarray
    context: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    lower: np.ndarray


def _mask(order: int) -> np.uint64:
    """The bits of a code's last ``order + 1`` symbols."""
    return np.uint64((1 << BITS * (order + 1)) - 1)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return np.flatnonzero(first)


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


@dataclass
class Model:
    order: int
    levels: list[Level]

    @classmethod
    def build(cls, code: np.ndarray, n: np.ndarray, order: int) -> Model:
        """From the counts of all grams of ``order + 1`` symbols; lower orders are their sums."""
        return cls.of([(code & _mask(k), n) for k in range(order + 1)])

    @classmethod
    def of(cls, grams: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """From (codes, counts) of each order, which may repeat a code; a context has all its symbols
        or none, and where it is there its suffixes are."""
        levels: list[Level] = []
        for k, (short, n) in enumerate(grams):
            place = np.argsort(short)
            short, total = short[place], n[place]
            start = _starts(short)
            short, total = short[start], np.add.reduceat(total, start) if len(start) else total
            context = short >> np.uint64(BITS)
            start = _starts(context)
            lower = np.zeros(len(start), np.int64)
            if k and len(short):
                found, _ = _find(levels[-1].code, short & _mask(k - 1))
                lower = np.add.reduceat(levels[-1].n[found], start)
            levels.append(Level(short, total, context[start], np.add.reduceat(total, start) if len(start) else lower, np.diff(np.append(start, len(short))).astype(np.int32), lower))
        return cls(len(grams) - 1, levels)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after the symbols before it."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        excluded, seen = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            short = code[left] & _mask(k)
            at, known = _find(level.context, short >> np.uint64(BITS))
            entry, hit = _find(level.code, short)
            if not len(level.context):
                continue
            fresh = np.where(known, level.distinct[at] - seen[left], 0)
            mass = np.where(known, level.total[at] - excluded[left], 0) + fresh
            some = mass > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit, np.log10(level.n[entry] / mass), np.where(some, np.log10(fresh / mass), 0.0))
            out[left] += gain
            excluded[left] = np.where(known, level.lower[at], 0)
            seen[left] = np.where(known, level.distinct[at], 0)
            left = left[~hit]
            if not len(left):
                return out
        out[left] -= np.log10(np.maximum(1, SYMBOLS - seen[left]))
        return out


@dataclass
class Language:
    """All that scoring needs on the executors; ``rest`` and ``grams`` stay tables.

    ``grams`` has all training grams where ``model`` holds frequent contexts only."""

    model: Model
    words: np.ndarray
    gains: np.ndarray
    tokens: int
    vocabulary: int
    texts: int
    rest: DataFrame | None = None
    grams: DataFrame | None = None
    partial: bool = False

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None, "grams": None}


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two long columns of a bounded table, gathered as Arrow without a copy to pandas."""
    got = df.toArrow()
    return tuple(np.asarray(got.column(k).combine_chunks()) for k in (0, 1))


def _grams(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    key, n = _columns(codes)
    return key.view(np.uint64), n


def frequent_contexts(grams: DataFrame) -> Model:
    """Orders 0 and 1 whole; of the others the contexts from a count on, the least power of two
    with which no order has more than ``MAX_GRAMS`` entries."""
    context, least, orders = F.shiftright("key", BITS).alias("context"), 0, {}
    for k in range(ORDER + 1):
        orders[k] = grams.groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(k)))).alias("key")).agg(F.sum("n").alias("n"))
        if k < 2:
            continue
        orders[k] = materialize(orders[k], "lm-order")
        sums = orders[k].groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
        sizes = sums.groupBy(F.floor(F.log2("total")).cast("int").alias("size")).agg(F.sum("entries").alias("entries")).collect()
        held = 0
        for r in sorted(sizes, key=lambda r: -r["size"]):
            held += r["entries"]
            if held > MAX_GRAMS:
                least = max(least, r["size"] + 1)
                break
    for k in range(2, ORDER + 1):
        some = orders[k].groupBy(context).agg(F.sum("n").alias("total")).where(F.col("total") >= F.lit(2.0) ** least).select("context")
        orders[k] = orders[k].withColumn("context", F.shiftright("key", BITS)).join(some, "context", "left_semi").select("key", "n")
    return Model.of([_grams(orders[k]) for k in range(ORDER + 1)])


def rare_scores(made: DataFrame, language: Language) -> DataFrame:
    """(uid, gained): summed scores of document grams after contexts that aren't broadcast."""
    low = made.sparkSession.sparkContext.broadcast([(x.code, x.n) for x in language.model.levels[:2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, model = [], None
        for b in batches:
            uid, key, n = (b.column(k) for k in range(3))
            key, n, asked = np.asarray(key).view(np.uint64), np.asarray(n), ~np.asarray(uid.is_null().to_numpy(zero_copy_only=False))
            trained.append((key[~asked], n[~asked]))
            if not asked.any():
                continue
            if model is None:  # training grams come first
                code, count = (np.concatenate(x) for x in zip(*trained, strict=True))
                model = Model.of([*low.value, *((code & _mask(k), count) for k in range(2, ORDER + 1))])
            place, grams = pd.factorize(key[asked])
            rows, ids = pd.factorize(np.asarray(uid.drop_null()))
            gained = np.bincount(rows, weights=model.log10(grams)[place] * n[asked], minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gained)], names=["uid", "gained"])

    asked = made.select("uid", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("uid", F.col("x.grams").alias("key"), F.col("x.gram_times").cast("long").alias("n"))
    both = language.grams.select(F.lit(None).cast("long").alias("uid"), "key", "n").unionByName(asked)
    dealt = both.repartition(F.shiftright("key", BITS).bitwiseAND(F.lit(int(_mask(1))))).sortWithinPartitions(F.col("uid").asc_nulls_first())
    return dealt.mapInArrow(run, "uid long, gained double").groupBy("uid").agg(F.sum("gained").alias("gained"))


def train(docs: DataFrame) -> Language:
    made = counts(docs)
    words, grams = made.where(F.col("kind") == WORD), made.where(F.col("kind") == GRAM)
    facts = words.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    texts = made.where(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    hot, least = 0, 64
    for r in sorted(facts, key=lambda r: -r["size"]):
        hot += r["words"]
        if hot > HOT_WORDS:
            break
        least = r["size"]
    key, n = _columns(words.where(F.col("n") >= F.lit(2.0) ** least).select("key", "n"))
    place = np.argsort(key)
    hot_words, gains = key[place], np.log10(n[place] + 1.0)
    grams = grams.select("key", "n")
    partial = grams.count() > MAX_GRAMS
    model = frequent_contexts(grams) if partial else Model.build(*_grams(grams), ORDER)
    total = sum(r["n"] for r in facts) + texts
    rest = words.where(F.col("n") < F.lit(2.0) ** least).select("key", "n")
    return Language(model, hot_words, gains, total, sum(r["words"] for r in facts) + (texts > 0), texts, rest, grams if partial else None, partial)


_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>, grams array<long>, gram_times array<int>"


def _lists(pairs: np.ndarray, keys: np.ndarray, rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """The different keys of each row and how often they occur; a pair is row * len(keys) + key."""
    pair, times = np.unique(pairs, return_counts=True)
    size = max(1, len(keys))
    offsets = pa.array(np.searchsorted(pair // size, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys[pair % size])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def score(docs: DataFrame, language: Language) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows of
    (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(language)
    smooth = np.log10(language.tokens + language.vocabulary + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for s in slices(b.column(2)):
                yield rows(b, s, known, at)
                at += s.rows

    def rows(b: pa.RecordBatch, s: Slice, known: Language, uid: int) -> pa.RecordBatch:
        code, starts = gram_codes(s, known.model.order)
        inverse, grams = pd.factorize(code)
        gains, sent, apart = np.zeros(len(grams)), np.zeros(len(grams), bool), _lists(np.empty(0, np.int64), grams.view(np.int64), s.rows)
        if known.partial:
            sent = ~_find(known.model.levels[-1].context, grams >> np.uint64(BITS))[1]
            at = np.flatnonzero(sent[inverse])
            apart = _lists(np.repeat(np.arange(s.rows), np.diff(starts))[at] * np.int64(len(grams)) + inverse[at], grams.view(np.int64), s.rows)
        gains[~sent] = known.model.log10(grams[~sent])
        gained = np.add.reduceat(gains[inverse], starts[:-1])
        row, n = s.word_rows(), s.counts()
        inverse, words = pd.factorize(s.hashes().view(np.int64))
        place, hot = _find(known.words, words)
        gain = np.where(hot, known.gains[place] if len(known.gains) else 0.0, 0.0)[inverse]
        hot = hot[inverse]
        base = np.bincount(row, weights=gain, minlength=s.rows) + np.log10(known.texts + 1.0)
        rare = np.flatnonzero(~hot)
        apart = [*_lists(row[rare] * np.int64(len(words)) + inverse[rare], words, s.rows), *apart]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(uid, uid + s.rows)), b.column(0).slice(s.first, s.rows), b.column(1).slice(s.first, s.rows), pa.array(n.astype(np.int64) + 1),
                pa.array((np.bincount(row[hot], minlength=s.rows) + (known.texts > 0)).astype(np.int64)), pa.array(base), pa.array(gained),
                *apart,
            ],
            names=[x.split()[0] for x in _SCORED.split(", ")],
        )

    made = materialize(docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, _SCORED), "lm-scores")
    pairs = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    found = pairs.join(language.rest, "key").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("known"))
    out = made.drop("rare", "times", "grams", "gram_times").join(found, "uid", "left")
    gained = F.col("score")
    if language.partial:
        out, gained = out.join(rare_scores(made, language), "uid", "left"), F.col("score") + F.coalesce("gained", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(language.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(smooth))).alias("base_score"), gained.alias("score"),
    )


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split(table(spark, sf_dir, "documents").select("doc_id", "text"), 7, 2)
    return score(docs, train(docs.where("not held_out")))


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op8_ppm_score``, which SQL can express; the score to 4 places."""
    return op8_ppm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


BASE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {held_out_sql(7, 2)} AS held_out, coalesce({words_sql('text')}, []) AS w FROM documents),
t AS MATERIALIZED (SELECT r, held_out, unnest(list_append(w, '')) AS token FROM d),
c AS MATERIALIZED (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
f AS (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base_score FROM t LEFT JOIN c USING (token), f GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 4) AS base_score FROM d JOIN s USING (r), f
"""

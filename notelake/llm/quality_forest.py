"""Quality rules: an isolation forest over rule statistics.

Every document gets its rule statistics in one pass over its whole text. A forest of random
splits is grown on a bounded, hash-chosen sample of labelled documents, few of them bad; the feature of a split
is drawn with a weight that says how well that feature tells the sample's labels apart. A
document's anomaly is ``2 ** (-mean path length / c(sample))``. The cut is calibrated over *all* labelled
rows (a histogram of anomalies, aggregated by Spark), never on a sample.

So labels guide the forest twice: which features a random split may draw, and how many bad rows a
tree sees. Split values, samples and the order of splits stay random (seeded).

Edge cases: a null or empty text has zero words and fails the base rule; very long texts are read
whole; a null ``doc_id`` is kept as it is (it can't be labelled); an id with several labels counts as
bad if one says so; equal statistics get equal verdicts; repeated rows are scored one by one; an
empty table, or
one without usable labels, gives a forest that accepts whatever the base rule accepts. Further
columns of the input are ignored by ``rule_statistics`` and passed through by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.lean import lean
from notelake.llm.words import mix, row_sums, slices
from notelake.storage import materialize, table

#: Labelled rows that the forest is grown on, at most.
FIT_ROWS = 8192
TREES, SAMPLE, SEED = 128, 256, 20240131
#: Share of a tree's sample that are rows labelled bad: few, or they would hide each other.
ODD = 0.02
#: Share of labelled good rows (that pass the base rule) the calibrated cut must keep.
KEEP_GOOD = 0.995
BINS = 2000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines"]
STATS_DDL = ", ".join(f"{c} long" for c in STATS)

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _repeat_words(h: np.ndarray, row_words: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur at least twice in their row."""
    counts = np.diff(row_words)
    out = np.zeros(len(counts), np.int64)
    n = len(h)
    if n < 3:
        return out
    row = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        key = mix(h[:-2] + mix(h[1:-1], 1) * np.uint64(3) + mix(h[2:], 2) * np.uint64(5), 4)
        key = mix(key ^ mix(row[:-2].astype(np.uint64), 5), 6)
    valid = row[:-2] == row[2:]
    at = np.flatnonzero(valid)
    order = np.argsort(key[at], kind="stable")
    ranked = key[at][order]
    same = np.zeros(len(ranked) + 1, bool)
    if len(ranked):
        same[1:-1] = ranked[1:] == ranked[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[twice + shift] = True
    return np.bincount(row[covered], minlength=len(counts)).astype(np.int64)


def _dup_lines(data: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    text = data[lo:hi].tobytes()
    if b"\n" not in text:
        return 0, 1 if text.strip(b" \t\n\x0b\x0c\r") else 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def batch_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in STATS}
    for s in slices(column, lower=False):
        lines = np.array([_dup_lines(s.data, a, b) for a, b in zip(s.row_bytes[:-1], s.row_bytes[1:], strict=True)], np.int64).reshape(-1, 2)
        parts["n_words"].append(s.counts())
        parts["word_chars"].append(row_sums(_LEAD[s.data] & s.inside, s.row_bytes))
        for name, lut in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            parts[name].append(row_sums(lut[s.data], s.row_bytes))
        parts["n_dup_lines"].append(lines[:, 0])
        parts["n_lines"].append(lines[:, 1])
        parts["n_repeat_words"].append(_repeat_words(s.hashes(), s.row_words))
    return {c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in parts.items()}


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Length-free ratios, so that a long text isn't odd for being long."""
    words, chars = np.maximum(stats["n_words"], 1), np.maximum(stats["word_chars"], 1)
    return np.stack(
        [
            stats["word_chars"] / words,
            stats["n_symbols"] / chars,
            stats["n_upper"] / chars,
            stats["n_marks"] / words,
            stats["n_digits"] / chars,
            stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1),
            np.maximum(stats["n_repeat_words"] / words - 0.2, 0),
        ],
        axis=1,
    )


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def split_weights(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How well the distance of each feature from its good median ranks bad rows above good ones.

    ``(2 * AUC - 1) ** 2``, 0 where bad rows aren't farther off. Without both labels: all equal.
    """
    if good.all() or not good.any():
        return np.ones(x.shape[1])
    off = np.abs(x - np.median(x[good], axis=0))
    out = []
    for k in range(x.shape[1]):
        g, b = np.sort(off[good, k]), off[~good, k]
        auc = (np.searchsorted(g, b, "left") + np.searchsorted(g, b, "right")).mean() / 2 / len(g)
        out.append(max(0.0, 2 * auc - 1) ** 2)
    w = np.array(out)
    return w if w.any() else np.ones(x.shape[1])


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right: + 1), length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    sample: int
    cut: float = 2.0

    @classmethod
    def grow(cls, x: np.ndarray, weights: np.ndarray | None = None, bad: np.ndarray | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
        weights = np.ones(x.shape[1]) if weights is None else weights
        rng = np.random.default_rng(seed)
        bad = np.zeros(len(x), bool) if bad is None else bad
        plain, odd = np.flatnonzero(~bad), np.flatnonzero(bad)
        if not len(plain):
            plain, odd = odd, plain
        some = min(len(odd), int(np.ceil(ODD * sample)))
        sample = min(sample, len(plain) + some)
        limit = int(np.ceil(np.log2(max(sample, 2)))) + 2
        built = []
        for _ in range(trees if sample else 0):
            feature, value, left, length = [-1], [0.0], [0], [0.0]
            drawn = np.concatenate([rng.choice(plain, sample - some, replace=False), rng.choice(odd, some, replace=False)])
            todo = [(0, x[drawn], 0)]
            while todo:
                node, rows, depth = todo.pop()
                lo, hi = rows.min(0), rows.max(0)
                open_ = np.flatnonzero((hi > lo) & (weights > 0))
                if depth >= limit or len(rows) < 2 or not len(open_):
                    length[node] = depth + _c(len(rows))
                    continue
                f = int(rng.choice(open_, p=weights[open_] / weights[open_].sum()))
                v = float(rng.uniform(lo[f], hi[f]))
                feature[node], value[node], left[node] = f, v, len(feature)
                low = rows[:, f] <= v
                for k, part in enumerate((rows[low], rows[~low])):
                    feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
                    todo.append((left[node] + k, part, depth + 1))
            built.append((feature, value, left, length))
        size = max((len(t[0]) for t in built), default=1)
        pad = lambda k, fill, kind: np.array([t[k] + [fill] * (size - len(t[k])) for t in built], kind).reshape(-1, size)
        return cls(pad(0, -1, np.int16), pad(1, 0.0, float), pad(2, 0, np.int32), pad(3, 0.0, float), sample)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length, strict=True):
            node = np.zeros(len(x), np.int32)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > value[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(_c(self.sample), 1e-9))

    def kept(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        ok = ~base_failed(stats)
        ok[ok] = self.anomaly(features({k: v[ok] for k, v in stats.items()})) <= self.cut
        return ok


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATS}


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id`` and the rule statistics of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in batch_statistics(b.column(1)).values())], names=["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id long, {STATS_DDL}")


def sampled(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, those of the least hash of ``doc_id``.

    Rows far above the cut are dropped in each task, so what meets in one place is a few times
    ``limit``, not as much for each task."""
    hashed = rows.withColumn("__hash", F.xxhash64("doc_id", F.lit(seed)))
    count = hashed.count()
    if count > 4 * limit:
        near = hashed.where(F.col("__hash") < F.lit(-(2**63) + int(2**64 * (2 * limit / count))))
        if near.count() >= limit:
            hashed = near
    return hashed.orderBy("__hash", *rows.columns).limit(limit).drop("__hash")


def fit(stats: DataFrame, labels: DataFrame) -> Forest:
    """Grows the forest on a sample of labelled rows and calibrates the cut over all labelled rows."""
    flags = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(flags, "doc_id")
    rows = materialize(rows.select("doc_id", "quality", *STATS), "quality-labelled")
    sample = sampled(rows, FIT_ROWS, SEED).toPandas()
    x = features({c: sample[c].to_numpy() for c in STATS})
    good = sample["quality"].to_numpy() == 1
    forest = Forest.grow(x, split_weights(x, good), ~good)
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = shared.value.anomaly(features(_columns(b)))
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array(np.minimum(a * BINS, BINS - 1).astype(np.int32))], names=["quality", "bin"])

    seen = rows.select("quality", *STATS).mapInArrow(lean(run), "quality int, bin int").groupBy("quality", "bin").count().collect()
    by = {q: np.zeros(BINS, np.int64) for q in (0, 1)}
    for r in seen:
        if r["quality"] in by:
            by[r["quality"]][r["bin"]] += r["count"]
    kept_good = np.cumsum(by[1]) / max(1, by[1].sum())
    cut_bad = 1 - np.cumsum(by[0]) / max(1, by[0].sum())
    allowed = np.flatnonzero(kept_good >= KEEP_GOOD)
    if by[1].sum() and by[0].sum() and len(allowed):
        best = allowed[np.argmax((kept_good + cut_bad)[allowed])]
        # half-way to the next bin with any labelled row, so that unseen good rows have room
        later = np.flatnonzero((by[0] + by[1])[best + 1 :])
        forest.cut = (best + 1 + (later[0] / 2 if len(later) else 0)) / BINS
    return forest


def verdicts(stats: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rule statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _columns(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base_failed(s)), pa.array(shared.value.kept(s))], names=[*b.schema.names, "base_failed", "kept"])

    return stats.select("doc_id", *STATS).mapInArrow(lean(run), f"doc_id long, {STATS_DDL}, base_failed boolean, kept boolean")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules and the forest keep."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(materialize(rule_statistics(docs), "quality-stats"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = shared.value.kept(batch_statistics(b.column(b.schema.get_field_index("text"))))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(rule_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    out = verdicts(stats, fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op4_quality_forest``, which SQL can express."""
    return op4_quality_forest(spark, sf_dir).drop("kept")


BASE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS MATERIALIZED (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) >= 3),
twice AS (SELECT r, x FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i FROM windows JOIN twice USING (r, x)),
repeated AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN repeated USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
"""

"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources of like size (classes by powers of four) share shards, ``PARTIES`` sources a shard or so; a
source beyond ``SHARD_TOKENS`` tokens is dealt over several by a hash of its documents. In a shard
each source is a stream of its documents in seeded order, cut into blocks; *all blocks of a shard
have the same number of tokens*, at least ``MIN_BLOCKS`` of them to a source if it has so many
tokens. Each shard hands out its blocks by highest quotients (wanted blocks / (2 k + 1)), never
more than twice a source's blocks, which gives integer quotas; a quota above the number of
blocks takes every block once and the rest again. Which blocks are in the rest is a seeded
systematic draw, for which the tokens taken of any document have a closed form: no block table
is made and nothing but sums per source and shard is shuffled.

Everything is DataFrame and SQL code, and no step needs all sources or a whole source in one task.
Only sizes and ids are shuffled, never texts.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, the
last in order; a null id and repeated rows are rows like others (ordered by hash of the id, then
size); a very long text is a long stretch of its stream, of which any blocks may be taken; equal
quotients go to the source that is first in order; an empty table, or one without words, gives
targets and takes of 0. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.storage import Scratch, materialize, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words (percent), and the cap of a source's share of itself.
SHARE_PERCENT, MAX_REPEATS = 150, 2
#: Most tokens of a block; 4 ** MIN_BLOCKS_LOG4 blocks are the least of a source that has the tokens.
BLOCK_TOKENS, MIN_BLOCKS_LOG4 = 1024, 4
#: Tokens of a source in a shard at most, and sources in a shard, about.
SHARD_TOKENS, PARTIES = 1 << 20, 16
#: Sources up to which their targets are broadcast to the documents.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each text, counted without splitting it."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def _hash(*parts: str) -> F.Column:
    """32 bits of a seeded hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def ranked_sources(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, rank): rank is the source's place in code point order, from 1.

    Sources are dealt by range and numbered in each range; the ranges' sizes shift the numbers."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    dealt = scratch.write(dealt, "mix-sources")
    shift, before = [], 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():
        shift.append((r["range"], before))
        before += r["count"]
    shifts = dealt.sparkSession.createDataFrame(shift, "range int, shift long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    numbered = dealt.withColumn("place", place).join(F.broadcast(shifts), "range")  # one row a range
    return numbered.select("source", "source_size", (F.col("place") + F.col("shift")).alias("rank"))


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, rank, source_size, target): shares by weight under the caps, the excess of full
    sources reshared by weight until no source is above its cap; one sum over the sources a time."""
    with Scratch(rows.sparkSession) as scratch:
        weights = F.array(*[F.lit(w) for w in WEIGHTS])
        per = ranked_sources(rows, scratch).withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
        per = scratch.write(per.withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double")), "mix-caps")
        budget = float(per.agg(F.sum("source_size")).first()[0] or 0) * (SHARE_PERCENT / 100.0)
        level, full = 0.0, -1
        while True:
            over = F.col("weight") * F.lit(level) > F.col("cap")
            r = per.agg(F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, F.col("cap"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
            if r["full"] == full or not r["open"]:
                break
            full, level = r["full"], (budget - (r["held"] or 0.0)) / r["open"]
        target = F.col("cap") if r["open"] is None else F.least("cap", F.lit(level) * F.col("weight"))
        return materialize(per.select("source", "rank", "source_size", target.alias("target")), "mix-targets")


def quotas(streams: DataFrame) -> DataFrame:
    """Sainte-Lague per shard: (rank, part, block, blocks, quota) from (class, shard, part, rank,
    block, blocks, wanted).

    A source's seats lie within ``sources / 2 + 1`` of its rounded share, so only quotients that
    near are listed; all those below are seats for certain.
    """
    shard = ["class", "shard", "part"]
    whole = Window.partitionBy(*shard)
    s = streams.withColumn("micro", F.floor(F.col("wanted") * 1_000_000 + 0.5).cast("long"))
    s = s.withColumn("seats", F.floor(F.sum("micro").over(whole) / 1_000_000.0 + 0.5).cast("long")).withColumn("parties", F.count(F.lit(1)).over(whole))
    s = s.withColumn("most", F.col("blocks") * MAX_REPEATS)
    s = s.withColumn("sure", F.greatest(F.lit(0), F.least("most", F.floor("wanted").cast("long")) - F.col("parties")).cast("long"))
    s = s.withColumn("given", F.sum("sure").over(whole))
    s = s.withColumn("last", F.least("most", F.col("sure") + 2 * F.col("parties") + 2))
    listed = s.withColumn("k", F.explode_outer(F.when(F.col("last") > F.col("sure"), F.sequence(F.col("sure"), F.col("last") - 1))))
    best = whole.orderBy((F.col("wanted") / (2 * F.col("k") + 1)).desc_nulls_last(), "rank")
    won = (F.col("k").isNotNull() & (F.row_number().over(best) <= F.col("seats") - F.col("given"))).cast("long")
    return listed.withColumn("won", won).groupBy("rank", "part").agg(F.first("block").alias("block"), F.first("blocks").alias("blocks"), (F.first("sure") + F.sum("won")).alias("quota"))


def _before(x: str) -> str:
    """SQL: tokens taken before stream position ``x``."""
    whole = f"({x} div block)"
    drawn = f"(({whole} + theta) * extra div blocks - theta * extra div blocks)"
    here = f"(({whole} + 1 + theta) * extra div blocks - ({whole} + theta) * extra div blocks)"
    return f"(base * {x} + block * {drawn} + ({x} % block) * {here})"


def mix(rows: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for rows of (doc_id, source, size)."""
    rows = materialize(rows, "mix-sizes")
    targets = source_targets(rows)
    bits = F.length(F.bin("source_size"))
    targets = targets.withColumn("class", ((bits - 1) / 2).cast("int"))
    counts = targets.groupBy("class").agg(F.count(F.lit(1)).alias("sources"))
    targets = targets.join(F.broadcast(counts), "class")  # a row a class, of which there are at most 32
    shards = F.greatest(F.lit(1), F.floor((F.col("sources") + PARTIES - 1) / PARTIES)).cast("long")
    targets = targets.withColumn("shard", _hash("rank") % shards).withColumn("block", F.least(F.lit(BLOCK_TOKENS).cast("long"), F.expr(f"shiftleft(1L, 2 * greatest(class - {MIN_BLOCKS_LOG4}, 0))")))
    few = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    at = F.md5(F.concat(F.lit(SEED + ":"), key))
    placed = rows.join(few, rows["source"].eqNullSafe(targets["source"])).select("doc_id", "size", "rank", "source_size", "target", "class", "shard", "block", at.alias("at"))
    parts = F.greatest(F.lit(1), F.floor((F.col("source_size") + SHARD_TOKENS - 1) / SHARD_TOKENS)).cast("long")
    placed = placed.withColumn("part", F.conv(F.substring("at", 25, 8), 16, 10).cast("long") % parts)
    placed = placed.withColumn("stop", F.sum("size").over(Window.partitionBy("rank", "part").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, 0)))
    streams = placed.groupBy("rank", "part").agg(F.sum("size").alias("tokens"), *[F.first(c).alias(c) for c in ("source_size", "target", "class", "shard", "block")]).where("tokens > 0")
    streams = streams.withColumn("blocks", F.floor((F.col("tokens") + F.col("block") - 1) / F.col("block")).cast("long"))
    streams = streams.withColumn("wanted", F.col("target") / F.col("source_size") * (F.col("tokens") / F.col("block")))
    plan = quotas(streams).withColumn("base", F.expr("quota div blocks")).withColumn("extra", F.expr("quota % blocks")).withColumn("theta", _hash("part", "rank") % F.col("blocks"))
    out = placed.drop("block").join(plan, ["rank", "part"], "left")
    taken = F.coalesce(F.expr(f"{_before('stop')} - {_before('(stop - size)')}"), F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents")))


OP2_SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
weighted AS (SELECT *, CAST(list_extract({list(WEIGHTS)}, CAST((rank - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS DOUBLE) AS weight,
  CAST(source_size * {MAX_REPEATS} AS DOUBLE) AS cap FROM ranked),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE_PERCENT / 100.0}e0
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighted),
reached AS (SELECT arg_min(level, (cap / weight, rank)) AS reached FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, rank, source_size, CASE WHEN reached IS NULL THEN cap ELSE least(cap, reached * weight) END AS target FROM levels, reached),
classed AS (SELECT *, CAST((length(bin(source_size)) - 1) // 2 AS BIGINT) AS class FROM targets),
grouped AS (SELECT *, least({BLOCK_TOKENS}, CAST(1 AS BIGINT) << CAST(2 * greatest(class - {MIN_BLOCKS_LOG4}, 0) AS BIGINT)) AS block,
  CAST(('0x' || substr(md5('{SEED}:' || rank), 1, 8)) AS BIGINT) % greatest(1, (count(*) OVER (PARTITION BY class) + {PARTIES - 1}) // {PARTIES}) AS shard FROM classed),
placed AS (SELECT r.doc_id, r.size, t.rank, t.source_size, t.target, t.class, t.shard, t.block, md5('{SEED}:' || coalesce(CAST(r.doc_id AS VARCHAR), '')) AS mark
  FROM rows r JOIN grouped t ON r.source IS NOT DISTINCT FROM t.source),
parted AS (SELECT *, CAST(('0x' || substr(mark, 25, 8)) AS BIGINT) % greatest(1, (source_size + {SHARD_TOKENS - 1}) // {SHARD_TOKENS}) AS part FROM placed),
streamed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY part, rank ORDER BY mark, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM parted),
s0 AS (SELECT class, shard, part, rank, block, CAST(sum(size) AS BIGINT) AS tokens, min(source_size) AS source_size, min(target) AS target FROM streamed GROUP BY ALL),
s2 AS (SELECT *, (tokens + block - 1) // block AS blocks, target / source_size * (tokens / block) AS wanted FROM s0 WHERE tokens > 0),
s3 AS (SELECT *, CAST(floor(CAST(sum(CAST(floor(wanted * 1000000 + 0.5e0) AS BIGINT)) OVER (PARTITION BY class, shard, part) AS DOUBLE) / 1000000.0e0 + 0.5e0) AS BIGINT) AS seats FROM s2),
quotients AS (SELECT class, shard, part, rank, seats, wanted / (2 * k + 1) AS q FROM (
  SELECT class, shard, part, rank, seats, wanted, unnest(range(0, blocks * {MAX_REPEATS})) AS k FROM s3)),
won AS (SELECT part, rank, count(*) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY class, shard, part ORDER BY q DESC, rank) AS place FROM quotients) WHERE place <= seats GROUP BY part, rank),
plan AS (SELECT s3.*, coalesce(quota, 0) // blocks AS base, coalesce(quota, 0) % blocks AS extra,
  CAST(('0x' || substr(md5('{SEED}:' || part || ':' || rank), 1, 8)) AS BIGINT) % blocks AS theta FROM s3 LEFT JOIN won USING (part, rank)),
pos AS (SELECT d.doc_id, d.size, d.source_size, d.target, p.base, p.extra, p.theta, p.block, p.blocks, d.stop AS hi, d.stop - d.size AS lo
  FROM streamed d LEFT JOIN plan p USING (part, rank))
SELECT doc_id, size, source_size, target, CAST(coalesce(
  (base * hi + block * ((hi // block + theta) * extra // blocks - theta * extra // blocks)
    + (hi % block) * ((hi // block + 1 + theta) * extra // blocks - (hi // block + theta) * extra // blocks))
  - (base * lo + block * ((lo // block + theta) * extra // blocks - theta * extra // blocks)
    + (lo % block) * ((lo // block + 1 + theta) * extra // blocks - (lo // block + theta) * extra // blocks)), 0) AS BIGINT) AS taken
FROM pos
"""

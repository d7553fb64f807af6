"""Connected components of an edge table by alternating large-star and small-star rounds.

Only edges are held, in tables of the shared folder, of which each round removes the last;
nothing but counts goes to the driver. Minima are pre-aggregated before the shuffle and joins on
a hot node can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.storage import Scratch, materialize


def _star(edges: DataFrame, both: DataFrame, keep: str) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, keeper: Scratch | None = None, label: str = "components") -> DataFrame:
    """``edges`` (u, v: long, undirected) to (node, root), root the least node it reaches.

    Nodes without an edge don't appear. Loops and repeated edges are harmless; an empty table
    gives an empty one. It ends when the edges are stars, for certain: each node has one lesser
    neighbour and no such neighbour has one itself. The result is a table of ``keeper``, or stays.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(both, both, "v > u").distinct()
            # small star: every node's lesser neighbours and itself point to the least of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            now = scratch.write(small.distinct(), label)
            ends = now.select("u", F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("high")))
            if ends.groupBy("u").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low + high > 1 and low > 0").isEmpty():
                break
        found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return keeper.write(found, label) if keeper else materialize(found, label)

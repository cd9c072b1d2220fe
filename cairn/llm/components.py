"""Connected components of an undirected graph given as edges, by alternating large and small stars.

Each round joins every node to the smallest label in reach and shortens paths,
so the number of rounds grows with the logarithm of the longest path. Minima are
aggregated before they are shuffled, so a hub with very many edges is one row per
map task; the rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tables import gathered, settled


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(lows.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node in reach) for every node of ``edges`` (a, b); loops and repeated edges are harmless."""
    at = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = settled(gathered(at))
    before, now = None, _state(at)
    while now != before:
        at = settled(gathered(_small_star(_large_star(at))))
        before, now = now, _state(at)
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

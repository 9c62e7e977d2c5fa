"""Connected components of links by alternating large and small stars, on DataFrames alone.

Every step replaces links by links to smaller nodes: the large star of a node links its larger
neighbours to the smallest of all its neighbours, the small star its smaller ones. The minimum of a
node is aggregated before it is shuffled, and hot nodes meet in plain joins, which adaptive
execution splits. Links are cut to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on distinct links (a > b)."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        down = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = down.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node."""
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.cut(clean, "links"), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, old = state, now
        now = scratch.cut(_star(_star(now, True), False), "links")
        scratch.drop(old)
    else:
        raise RuntimeError("components didn't converge")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

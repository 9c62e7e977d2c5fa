"""Exact ranks of any number of values, by rounds of histograms.

For each group and rank asked for, a round counts the values of an interval in equal buckets, with each bucket's own least and
greatest value, and goes on with the bucket that holds the rank. A round's counts are partial aggregates: a task holds
buckets, not values, and no value is sorted. An interval's ends always fall into different buckets, so it shrinks until
its ends meet; a value that repeats is one end of the interval however often it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

BUCKETS = 1024


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """0 for the low end, the last one for the high end; halved first, as a difference of doubles may overflow."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.least(F.floor(share * buckets), F.lit(buckets - 2)).cast("int")
    return F.when(value >= high, buckets - 1).when(value <= low, 0).otherwise(F.greatest(inner, F.lit(0)))


def at_ranks(rows: DataFrame, by: list[str], value: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(*by, name, value): the value at each ``asked`` rank (*by, name, rank), counted from 0 in ascending order.

    Null and NaN values aren't counted; ranks beyond the last are left out. Values are compared as doubles.
    """
    number = F.col(value).cast("double")
    held = rows.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("__v"))
    whole = held.groupBy(*by).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count("*").alias("__n"))
    open_ = asked.join(whole, by).where((F.col("rank") >= 0) & (F.col("rank") < F.col("__n"))).select(*by, "name", F.col("rank").cast("long").alias("rank"), "low", "high")
    state = cut(open_, "rank-state")
    keys = [*by, "name"]
    while not state.where("low < high").isEmpty():
        asking = state.where("low < high")
        inside = held.join(asking, by).where("__v >= low AND __v <= high")
        counted = inside.groupBy(*keys, "rank", _bucket(F.col("__v"), F.col("low"), F.col("high"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
        hit = counted.withColumn("before", upto - F.col("n")).where("rank >= before AND rank < before + n")
        state = cut(state.where("low >= high").unionByName(hit.select(*keys, (F.col("rank") - F.col("before")).alias("rank"), "low", "high")), "rank-state")
    return state.select(*keys, F.col("low").alias("value"))


def at_shares(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """(*by, <name>...): of each group's n values, that at place floor(n * share) in ascending order, for each named share below one."""
    number = F.col(value).cast("double")
    counted = rows.where(number.isNotNull() & ~F.isnan(number)).groupBy(*by).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("share")) for k, v in shares.items())))
    asked = counted.select(*by, "n", named.alias("x")).select(*by, F.col("x.name").alias("name"), F.floor(F.col("n") * F.col("x.share")).alias("rank"))
    found = at_ranks(rows, by, value, asked, buckets)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in shares))

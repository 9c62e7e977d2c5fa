"""A join of many rows with facts of their keys, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast, at most.
HEAVY_KEYS = 4096


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, most: int = HEAVY_KEYS) -> DataFrame:
    """``rows`` inner joined with ``facts``, which has each key once and in ``count`` at least how many rows hold it.

    Fewer than ``most`` keys can have more than ``total / most`` of the ``total`` rows: those are broadcast. All
    others meet in a shuffle, in which no key has more than that share.
    """
    heavy = F.col(count) * most > total
    few, many = F.broadcast(facts.where(heavy)), facts.where(~heavy)
    rest = rows.join(few.select(key), key, "left_anti").join(many.hint("merge"), key)
    return rows.join(few, key).unionByName(rest)

"""Bloom filters as constants of a plan, made and asked by SQL functions alone.

Bits are set on the executors; the filter's words come to the driver's JVM once and go into the plan as an array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """A Bloom filter: a constant array of words of 64 bits, their number of bits and that of hashes."""

    words: Column
    bits: int
    hashes: int


def _position(key: Column, i: Column, bits: int, n: int) -> Column:
    """Of the i-th hash: a double hash of the key, seeded by the level."""
    one, two = (F.pmod(F.xxhash64(key, F.lit(2 * n + j)), F.lit(bits)) for j in (0, 1))
    return F.pmod(one + i * two, F.lit(bits))


def holds(level: Level, key: Column, n: int) -> Column:
    """Does level n hold the key?"""

    def is_set(i: Column) -> Column:
        at = _position(key, i, level.bits, n)
        return F.getbit(F.get(level.words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0), F.lit(level.hashes - 1)), is_set)


def make_level(keys: DataFrame, count: int, false_bits: int, n: int, most_bits: int | None = None) -> Level:
    """Level n of the ``count`` keys in column ``k``; its bits are OR-ed by position on the executors.

    It lets through one in ``2 ** false_bits`` other keys, or more where that would take over ``most_bits``.
    """
    words = max(1, math.ceil(count * false_bits / math.log(2) / 64))
    if most_bits is not None and 64 * words > most_bits:
        words = max(1, most_bits // 64)
        false_bits = max(1, min(false_bits, round(64 * words / count * math.log(2))))
    at = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(false_bits - 1)), lambda i: _position(F.col("k"), i, 64 * words, n))).alias("at"))
    made = at.groupBy(F.expr("at div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    full = keys.sparkSession.range(words).join(made, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words"))
    # the array goes from the driver's JVM into the plan as it is
    functions = keys.sparkSession._jvm.org.apache.spark.sql.functions
    return Level(Column(functions.lit(row._jdf.head().get(0))), 64 * words, false_bits)

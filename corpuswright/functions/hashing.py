"""Reproducible decisions from hashes: every choice is a function of names, never of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the split rule: held-out buckets are below the first bound, retrieval-only ones below the second.
HELD_OUT_BELOW, RAG_ONLY_BELOW = 8, 16


def _text(part: Column | str | int) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def stable_int(*parts: Column | str | int) -> Column:
    """48 bits of the SHA-256 of the parts joined by the unit separator. Strings are literals."""
    digest = F.sha2(F.concat_ws("\x1f", *map(_text, parts)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def bucket(key: Column) -> Column:
    return stable_int("bucket", key) % 100


def chance(share: float, *parts: Column | str | int) -> Column:
    """True for about this share of keys, and always for the same ones."""
    return stable_int(*parts) % 10_000 < F.lit(share * 10_000)


def entity_group(key: Column) -> Column:
    """seen, rag_only, heldout_val or heldout_test."""
    b = bucket(key)
    held = F.when(stable_int("half", key) % 2 == 1, "heldout_val").otherwise("heldout_test")
    return F.when(b < HELD_OUT_BELOW, held).when(b < RAG_ONLY_BELOW, "rag_only").otherwise("seen")


def slots_by_hash(slots: tuple[int, ...], *parts: Column | str | int) -> Column:
    """The slots as an array, in the order of their hash."""
    ordered = F.array_sort(F.array(*(F.struct(stable_int(*parts, s).alias("h"), F.lit(s).alias("s")) for s in slots)))
    return F.transform(ordered, lambda x: x["s"])

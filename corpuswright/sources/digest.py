"""A digest of a data set that depends on its rows alone, not on files or partitions, and tells where two differ.

Rows are leaves of a hash tree in the order of a hash of their key. A node stands for all rows whose key hash begins with
its hexadecimal prefix; it is the SHA-256 of its children's prefixes and digests in order, and the lowest nodes' children are rows. Every
level is an aggregate of the one below. Key hashes are even, so a lowest node has few rows; the
depth is chosen once for a data set and kept with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

#: Hexadecimal digits that a level adds to its parent's prefix.
DIGITS = 2


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each column's name, and its value as JSON with nulls kept."""
    values = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.sha2(values, 256)


def _joined(rows: DataFrame, prefix: Column, child: str) -> DataFrame:
    """Nodes of their children's (child, digest, n)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(child).alias("c"), F.col("digest").alias("d"))))
    text = F.concat_ws(",", F.transform(listed, lambda x: F.concat(x["c"], F.lit(":"), x["d"])))
    return rows.groupBy(prefix.alias("prefix")).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"))


def tree(df: DataFrame, key: str, levels: int = 2, columns: list[str] | None = None) -> DataFrame:
    """(level, prefix, digest, n) of all nodes; level 0 is the root, whose prefix is empty. An empty data set has no node."""
    rows = df.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias("h"), row_digest(columns or df.columns).alias("digest"), F.lit(1).cast("long").alias("n"))
    nodes = cut(_joined(rows, F.substring("h", 1, DIGITS * levels), "h").withColumn("level", F.lit(levels)), "digest-tree")
    every = nodes
    for level in range(levels - 1, -1, -1):
        nodes = _joined(nodes, F.substring("prefix", 1, DIGITS * level), "prefix").withColumn("level", F.lit(level))
        every = every.unionByName(nodes)
    return every.select("level", "prefix", "digest", "n")


def root(df: DataFrame, key: str, levels: int = 2, columns: list[str] | None = None) -> str:
    """The digest of the whole; of nothing, the SHA-256 of an empty string."""
    found = tree(df, key, levels, columns).where("level = 0").first()
    return found["digest"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def differing(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(prefix) of the lowest nodes that two trees don't share, found level by level below nodes that differ."""
    depth = max(kept.agg(F.max("level")).first()[0] or 0, now.agg(F.max("level")).first()[0] or 0)
    below = None
    for level in range(depth + 1):
        a, b = (x.where(F.col("level") == level).select("prefix", F.col("digest").alias(n)) for x, n in ((kept, "a"), (now, "b")))
        met = a.join(b, "prefix", "full").where("NOT (a <=> b)").select("prefix")
        if below is not None:
            met = met.join(below.select(F.col("prefix").alias("up")), F.substring("prefix", 1, DIGITS * (level - 1)) == F.col("up"), "left_semi")
        below = cut(met, "digest-faults")
        if below.isEmpty():
            break
    return below


def changed_rows(kept: DataFrame, now: DataFrame, key: str, levels: int = 2, columns: list[str] | None = None) -> DataFrame:
    """(key, fault) of rows that are missing, added or changed; only rows below differing nodes are compared."""
    columns = columns or kept.columns
    places = differing(tree(kept, key, levels, columns), tree(now, key, levels, columns))

    def under(df: DataFrame, name: str) -> DataFrame:
        prefix = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, DIGITS * levels)
        rows = df.select(F.col(key).alias("key"), row_digest(columns).alias("d"), prefix.alias("prefix")).join(places, "prefix", "left_semi")
        return rows.groupBy("key").agg(F.sort_array(F.collect_list("d")).alias(name))

    both = under(kept, "a").join(under(now, "b").withColumnRenamed("key", "key_b"), F.col("key").eqNullSafe(F.col("key_b")), "full")
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("changed")
    return both.where("NOT (a <=> b)").select(F.when(F.col("a").isNull(), F.col("key_b")).otherwise(F.col("key")).alias("key"), fault.alias("fault"))

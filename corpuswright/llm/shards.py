"""Contiguous, byte-balanced shards from global prefix sums.

Documents are put in the order of their ids by range partitioning; only (doc_id, size, checksum) is
shuffled, never a text. Each range partition adds up its sizes and rows; the partitions' totals, a
row each, give every partition the bytes and rows before it, and so every document its global
offset. The byte line from 0 to the total is cut at equal targets; a document belongs to the shard
in which its middle lies. Shards are therefore contiguous in id order and differ from the equal
share by less than one document's size at each end.

The ordered sizes are a table in the shared folder, so that later steps see the same partitions
even if executors are lost. Ranges are of (id, size, checksum), so rows of one id, or without one, are spread too.

Defined results: a null text has size 8 and checksum 0; a null doc_id sorts first; repeated ids
are ordered by size and checksum, and equal rows get neighbouring slots; an empty table gives an
empty table; with fewer documents than shards some shards are empty. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

ROW_BYTES = 8
SHARDS = 24


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of every document, on the JVM."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the bytes and rows before each row within it."""
    part, before, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        total = np.cumsum(b.column("size").to_numpy())
        n = b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(before + np.append(0, total[:-1])), pa.array(rows + np.arange(n))], names=[*b.schema.names, "part", "bytes_before", "rows_before"])
            before, rows = before + int(total[-1]), rows + n


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    placed = sizes(docs).repartitionByRange("doc_id", "size", "text_crc32").sortWithinPartitions("doc_id", "size", "text_crc32")
    ordered = scratch.cut(placed.mapInArrow(_running, "doc_id long, size long, text_crc32 long, part int, bytes_before long, rows_before long"), "shard-sizes")
    # a row for each partition: the one thing that the driver holds
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    offsets, at, rows = [], 0, 0
    for t in totals:
        offsets.append((t.part, at, rows))
        at, rows = at + t.bytes, rows + t.rows
    base = F.broadcast(spark.createDataFrame(offsets, "part int, part_bytes long, part_rows long"))
    start = F.col("bytes_before") + F.col("part_bytes")
    middle = F.expr(f"cast(({shards} * (2 * cast(bytes_before + part_bytes as decimal(30,0)) + size)) div (2 * {max(at, 1)}L) as int)")
    whole = ordered.join(base, "part").select("doc_id", "size", "text_crc32", start.alias("start"), (F.col("rows_before") + F.col("part_rows")).alias("row"), F.least(middle, F.lit(shards - 1)).alias("shard"))
    firsts = F.broadcast(whole.groupBy("shard").agg(F.min("row").alias("first")))  # a row for each shard
    return whole.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), "start")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write (doc_id, text) as Parquet, a folder for each shard, in slot order; the assignment.

    Ids must be unique here: texts are joined to their shards by id.
    """
    placed = assign(docs, shards)
    rows = docs.select("doc_id", "text").join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 byte by byte; every running sum over all rows.
OP3_SQL = """
WITH crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT text, hex(text) AS h FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
bytes AS (SELECT text, list_transform(range(strlen(text)), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b FROM texts),
sums AS (SELECT text, xor(list_reduce([4294967295] || b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, crc),
sized AS (SELECT doc_id, strlen(coalesce(d.text, '')) + 8 AS size, text_crc32 FROM documents d JOIN sums s ON s.text = coalesce(d.text, '')),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, least(23, 24 * (2 * start + size) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""

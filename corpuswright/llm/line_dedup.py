"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, in lower case; keys of enough characters count. Their
128-bit hashes lie in runs: tables of (key, n, owner) bucketed and sorted by key, so that runs meet in merge joins
without a shuffle. ``n`` counts the documents of one or more batches that hold the key. ``owner`` is the largest doc_id of the
first batch that held it: every new batch is merge-anti-joined with the runs, its new keys get an owner, known ones
only add to the count, and that is the batch's own run. When a level has ``fanout`` runs, they are compacted into one run of the
next level by merge joins.

Batches are ranges of doc_id, the largest first, so that a key's owner is the largest document that holds it. At the end
the runs are merged into one, and the keys found in enough documents lose their lines in all documents but the owner.

Counts are aggregated before they are shuffled, and where lines meet the counts again, hot keys are broadcast: a
fixed number at most (``skew``). Every table lies in the shared folder. A document's dropped keys are the only
thing gathered, no more than it has lines.

Defined results: a null or empty text has one empty line; each row counts as a document, whether or not its doc_id
repeats, and all rows with the owner's id keep the line; null ids are the smallest; repeated lines of one
document count once and fall or stay together; an empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, skew
from . import textkit as tk


@dataclass(frozen=True)
class Params:
    min_chars: int = 40
    min_docs: int = 5
    batches: int = 4
    fanout: int = 2


@dataclass
class Lines:
    """A block's lines: their ranges, where each text's lines begin, and the keys of those that count (by line)."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    keyed: np.ndarray
    keys: list[bytes]


def split_lines(buf: np.ndarray, offs: np.ndarray, min_chars: int) -> Lines:
    breaks = np.flatnonzero(buf == 10)
    starts, ends = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([offs[1:], breaks]))
    ptr = np.searchsorted(breaks, offs) + np.arange(len(offs))
    full = np.flatnonzero(~tk.SPACES[buf])
    first, last = np.searchsorted(full, starts), np.searchsorted(full, ends)
    has = np.flatnonzero(last > first)
    a, b = full[first[has]], full[last[has] - 1] + 1
    chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    enough = chars[b] - chars[a] >= min_chars
    low = tk.LOWER[buf].tobytes()
    keys = [hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(a[enough].tolist(), b[enough].tolist())]
    return Lines(starts, ends, ptr, has[enough], keys)


def line_keys(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, tag, keys): the distinct keys of each row; ``tag`` is the text's checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                found = split_lines(buf, offs, p.min_chars)
                raw, cut = buf.tobytes(), np.searchsorted(found.keyed, found.ptr).tolist()
                rows = [list(dict.fromkeys(found.keys[i:j])) for i, j in zip(cut, cut[1:])]
                tags = [zlib.crc32(raw[i:j]) for i, j in zip(offs.tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(tags, pa.int64()), pa.array(rows, pa.list_(pa.binary()))], names=["doc_id", "tag", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tag long, keys array<binary>")


class LineRuns:
    """Levelled sorted runs; ``add`` takes a batch, ``merged`` is one run of everything."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str, str]]] = []  # the youngest runs first
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> tuple[DataFrame, str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch.new_folder(self.spark, "line-run")
        scratch.hold_table(self.spark, name)
        run.select("key", "n", "owner").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name), name, path

    def _runs(self) -> list[DataFrame]:
        """All runs, the earliest first."""
        return [run for level in reversed(self.levels) for run, _, _ in level]

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, the earliest first; the owner is the first's that has one."""
        out = runs[0]
        for run in runs[1:]:
            later = run.select("key", F.col("n").alias("n_later"), F.col("owner").alias("owner_later"), F.lit(True).alias("held"))
            out = out.hint("merge").join(later, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n_later", F.lit(0))).alias("n"), F.coalesce("owner", "owner_later").alias("owner"))
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, key), each pair once; its run: an owner only for keys that no earlier run has."""
        own = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
        known = F.lit(False)
        for i, run in enumerate(self._runs()):
            own = own.hint("merge").join(run.select("key", F.lit(True).alias(f"in_{i}")), "key", "left")
            known = known | F.col(f"in_{i}").isNotNull()
        made = self._write(own.select("key", "n", F.when(~known, F.col("owner")).alias("owner")))
        self._place(made, 0)
        return made[0]

    def _place(self, made: tuple[DataFrame, str, str], level: int) -> None:
        """``fanout`` runs of a level are compacted into one of the next."""
        if level == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        runs.append(made)
        if len(runs) >= self.fanout:
            self.levels[level] = []
            self._place(self._write(self._merge([run for run, _, _ in runs])), level + 1)
            self._drop(runs)

    def _drop(self, runs: list[tuple[DataFrame, str, str]]) -> None:
        for _, name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            scratch.remove(self.spark, path)

    def merged(self) -> DataFrame:
        return self._merge(self._runs())


def drops(keyed: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, tag, dropped): the keys that each document loses, of ``line_keys`` kept as a table."""
    spark = keyed.sparkSession
    shares = [i / p.batches for i in range(p.batches - 1, 0, -1)]
    cuts = [x for x in keyed.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []] if shares else []
    batch = F.lit(len(cuts))  # null ids come last
    for i, low in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > low, i).otherwise(batch)
    runs, pairs = LineRuns(spark, p.fanout), keyed.select("doc_id", F.explode("keys").alias("key"))
    for i in range(len(cuts) + 1):
        runs.add(pairs.where(batch == i))
    total = keyed.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    often = runs.merged().where(F.col("n") >= p.min_docs)
    met = skew.join_facts(keyed.select("doc_id", "tag", F.explode("keys").alias("key")), often, "key", "n", total)
    return met.where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("doc_id", "tag").agg(F.collect_set("key").alias("dropped"))


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the text of each row of ``docs`` (doc_id, text) without its dropped lines."""
    lost = drops(scratch.cut(line_keys(docs, p), "line-keys"), p).select(F.col("doc_id").alias("lost_id"), F.col("tag").alias("lost_tag"), "dropped")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.crc32(F.col("text").cast("binary")))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("tag") == F.col("lost_tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                found, raw = split_lines(buf, offs, p.min_chars), buf.tobytes()
                cut, n_dropped, kept = np.searchsorted(found.keyed, found.ptr).tolist(), [], []
                for t, lost in enumerate(b.column("dropped").slice(first, last - first).to_pylist()):
                    gone = {line for line, key in zip(found.keyed[cut[t] : cut[t + 1]].tolist(), found.keys[cut[t] : cut[t + 1]]) if key in lost} if lost else ()
                    n_dropped.append(len(gone))
                    stay = [raw[found.starts[x] : found.ends[x]] for x in range(found.ptr[t], found.ptr[t + 1]) if x not in gone] if gone else [raw[offs[t] : offs[t + 1]]]
                    kept.append(b"\n".join(stay).decode())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(np.diff(found.ptr)), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.select("doc_id", "text", "dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

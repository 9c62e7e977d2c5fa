"""Importance resampling towards a target distribution of hashed n-grams.

1. Identical texts are collapsed by grouping the full text; each distinct text keeps how often it stands in the corpus.
2. The features of every distinct text (runs of words, hashed into buckets) are counted once and kept as a table.
3. Bucket sums of the corpus are those counts times the multiplicity; bucket sums of the target come from its texts. Both have
   a fixed number of buckets, and so have the gains: how much likelier the target is to use a bucket.
4. A text's weight is the sum of its features' gains, computed once, and joined back to its documents by the text's SHA-256. Texts
   that hold a great share of all documents, a fixed number at most, are broadcast (``skew``).
5. Only then each document gets its own noise, the Gumbel of a hash of its id, so that copies are drawn apart. The highest scores are
   drawn without replacement: documents are ranked by range-partitioned running counts, of which a row for
   each partition goes to the driver.

Defined results: null and empty texts have no features and weight 0; a null doc_id has the noise of an empty id; rows that
share id and text have equal scores and ranks next to one another; without a target all gains come from
its zero counts; an empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, skew
from . import textkit as tk

_BETWEEN = tk.byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_SHORT = 64  # bytes of a feature that are hashed side by side


@dataclass(frozen=True)
class Params:
    longest_run: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _crc_table() -> np.ndarray:
    """Of every byte, by the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each range of bytes; byte by byte of all short ranges at once."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    lens, at = lens[order], starts[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long_ = int(np.searchsorted(-lens, -_SHORT, side="left"))
    for j in range(int(lens[long_]) if long_ < len(lens) else 0):
        n = int(np.searchsorted(-lens, -j, side="left"))
        c = crc[long_:n]
        crc[long_:n] = _CRC[(c ^ buf[at[long_:n] + j]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long_):
        crc[i] = zlib.crc32(buf[at[i] : at[i] + lens[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def block_features(buf: np.ndarray, offs: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then the distinct (text, bucket) of its features, in order, and their counts."""
    low = tk.LOWER[buf]
    starts, ends, ptr = tk.split(low, offs, _BETWEEN)
    owner = tk.owners(ptr)
    if p.longest_run > 1:  # the words side by side, one space after each
        size = ends - starts + 1
        first = np.cumsum(size) - size
        flat = np.full(int(size.sum()), 32, np.uint8)
        put = np.arange(len(flat)) - np.repeat(first, size)
        word = put < np.repeat(size - 1, size)
        flat[word] = low[(np.repeat(starts, size) + put)[word]]
        low, starts, ends = flat, first, first + size - 1
    keys = []
    for n in range(1, p.longest_run + 1):
        m = max(0, len(starts) - n + 1)
        same = owner[:m] == owner[n - 1 :] if m else np.zeros(0, bool)
        at = np.flatnonzero(same)
        keys.append(owner[at] * p.buckets + crc32_ranges(low, starts[at], ends[at + n - 1]) % p.buckets)
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return np.diff(ptr), found // p.buckets, found % p.buckets, counts


def features(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """(digest, copies, n_words, n_features, buckets, counts) of every distinct text of ``texts`` (text)."""
    once = texts.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = once.select(_digest().alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                n, text, bucket, count = block_features(buf, offs, p)
                ptr = pa.array(np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32))
                total = np.append(0, np.cumsum(count))[ptr.to_numpy()]
                lists = [pa.ListArray.from_arrays(ptr, pa.array(x.astype(np.int32))) for x in (bucket, count)]
                columns = [b.column(c).slice(first, last - first) for c in ("digest", "copies")] + [pa.array(n.astype(np.int64)), pa.array(np.diff(total)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "copies", "n_words", "n_features", "buckets", "counts"])

    return keyed.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, buckets array<int>, counts array<int>")


def _digest():  # noqa: ANN202
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of all entries of a batch of features."""
    lists = b.column("buckets")
    return np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy().astype(np.int64)


def bucket_sums(found: DataFrame, p: Params = Params()) -> list[int]:
    """How many features of all texts, copies included, fall into each bucket: a fixed number of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            row, bucket, count = _flat(b)
            np.add.at(total, bucket, count * b.column("copies").to_numpy()[row])
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["bucket", "n"])

    rows = found.select("copies", "buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * p.buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket, a thousand times the log of its share in the target over that in the source, both smoothed by one."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source, target)]


def weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of every distinct text."""
    table = np.array(gain, np.int64)  # a long for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, bucket, count = _flat(b)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, row, table[bucket] * count)
            kept = [b.column(c) for c in ("digest", "copies", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], names=["digest", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id, seed: str):  # noqa: ANN001, ANN201
    """A thousand times a Gumbel variable of the id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place of each row within it."""
    part, rows = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows + np.arange(n))], names=[*b.schema.names, "part", "place"])
        rows += n


def drawn(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds ``rank`` to ``scored`` (doc_id, n_words, n_features, weight, score): 1, 2, ... for the documents drawn, else null."""
    spark = scored.sparkSession
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc()]
    rows = scored.select("doc_id", "n_words", "n_features", "weight", "score", (F.col("n_words") >= p.min_words).alias("able"))
    placed = scratch.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "doc_id long, n_words long, n_features long, weight long, score long, able boolean, part int, place long"), "resample-order")
    totals = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    draw = sum(t["able"] for t in totals) * p.percent // 100
    before, at = [], 0
    for t in totals:
        before.append((t["part"], at))
        at += t["n"]
    base = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    rank = F.col("place") + F.col("before") + 1
    return placed.join(base, "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text) towards ``target`` (text)."""
    found = scratch.cut(features(docs, p), "resample-features")
    gain = gains(bucket_sums(found, p), bucket_sums(features(target, p), p))
    total = found.agg(F.sum("copies")).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    joined = skew.join_facts(rows, weights(found, gain), "digest", "copies", total)
    return drawn(joined.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), p.seed)).alias("score")), p)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 byte by byte, of each distinct word.
OP11_SQL = """
WITH crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
split AS (
  SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
words AS (SELECT side, id, unnest(words) AS word FROM split),
bytes AS (SELECT word, list_transform(range(strlen(word)), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(word), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(word), 2 * i + 2, 1)) - 1) AS b FROM (SELECT DISTINCT word FROM words)),
bucket AS (SELECT word, xor(list_reduce([4294967295] || b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM bytes, crc),
hits AS (SELECT side, id, k FROM words JOIN bucket USING (word)),
sums AS (SELECT r.k, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM range(10000) r(k) LEFT JOIN hits h ON h.k = r.k GROUP BY r.k),
gain AS (SELECT k, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
weighed AS (SELECT id, sum(g)::BIGINT AS weight FROM hits JOIN gain USING (k) WHERE side = 's' GROUP BY id),
h AS (SELECT id, len(words) AS n, list_reduce([0] || list_transform(range(8), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || id), i + 1, 1)) - 1), lambda a, x: 16 * a + x) AS h FROM split WHERE side = 's'),
scored AS (SELECT h.id AS doc_id, n AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN weighed w ON w.id = h.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, (SELECT count(*) FROM scored WHERE n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM ranked
"""

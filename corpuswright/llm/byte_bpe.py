"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Texts are cut into pre-tokens, in chunks of about ``CHUNK_BYTES`` of text. A chunk keeps the
   distinct pre-tokens it holds and, for every position, which of them stands there. Chunks are a
   table in the shared folder, bucketed by their key.
2. The distinct words of all chunks are shuffled by buckets of a hash of the word, as many as the corpus needs, so that each
   distinct word of the corpus meets in one place, and are encoded there once.
3. The ids go back to the chunks that asked for them and are joined to the chunks. The chunks are
   bucketed, so only the ids are shuffled; every position then takes its word's ids in order.
4. Decoding looks the ids up in the table of token bytes, whose size is the vocabulary's, as an array in each worker.

Chunks are of bounded size whatever their rows are, so neither a source nor a group of copies nor a
frequent word weighs on one task: a word occurs at most once per chunk in the shuffle. A single
text longer than a chunk is a chunk of its own. Lost executors are made up for from the bucketed
table and shuffles; nothing lies in machine-local folders.

Pre-tokens are told apart by their bytes, in a chunk and in the shuffle.

Defined results: a null or empty text has no ids; null ids stay null; repeated rows each have their
own, equal results; an empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scratch
from . import textkit as tk

CHUNK_BYTES = 12 << 20
#: Bytes of words that a bucket of the shuffle holds, about, and the least and most buckets.
BUCKET_BYTES = 4 << 20
BUCKETS = (256, 1 << 16)
KNOWN_WORDS = 4_000_000
CHUNKS = "chunk long, doc_ids array<long>, counts binary, sequence binary, words binary, lengths binary, buckets binary"


def _join(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def pack(codes: np.ndarray) -> bytes:
    """Ranks as one, two or three bytes each, the frequent ones short.

    Bytes below 192 are ranks; 192 to 247 begin a pair; 248 to 255 begin a triple or, from a rank of
    ``192 + 56 * 256 + 7 * 65536`` on, a marker with four bytes.
    """
    codes = codes.astype(np.int64)
    two, three = 192 + 56 * 256, 192 + 56 * 256 + 7 * 65536
    size = 1 + (codes >= 192) + (codes >= two) + 2 * (codes >= three)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    a = codes < 192
    out[at[a]] = codes[a]
    b = (codes >= 192) & (codes < two)
    v = codes[b] - 192
    out[at[b]], out[at[b] + 1] = 192 + (v >> 8), v & 255
    c = (codes >= two) & (codes < three)
    v = codes[c] - two
    out[at[c]], out[at[c] + 1], out[at[c] + 2] = 248 + (v >> 16), (v >> 8) & 255, v & 255
    d = codes >= three
    v = codes[d]
    out[at[d]] = 255
    for j in range(4):
        out[at[d] + 1 + j] = (v >> (24 - 8 * j)) & 255
    return out.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``pack`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    width = np.where(raw < 192, 1, np.where(raw < 248, 2, np.where(raw < 255, 3, 5))).astype(np.int64)
    # a byte begins a rank if it is reached from the first: follow the chain by doubling
    at = _chain(width, n)
    b = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    lead, two = b[at], 192 + 56 * 256
    out = lead.copy()
    m = (lead >= 192) & (lead < 248)
    out[m] = 192 + ((lead[m] - 192) << 8) + b[at[m] + 1]
    m = (lead >= 248) & (lead < 255)
    out[m] = two + ((lead[m] - 248) << 16) + (b[at[m] + 1] << 8) + b[at[m] + 2]
    m = lead == 255
    out[m] = (b[at[m] + 1] << 24) + (b[at[m] + 2] << 16) + (b[at[m] + 3] << 8) + b[at[m] + 4]
    return out


def _chain(width: np.ndarray, n: int) -> np.ndarray:
    """Positions 0, w[0], w[0] + w[w[0]], ...: n of them."""
    if not n:
        return np.zeros(0, np.int64)
    jump = np.minimum(np.arange(len(width)) + width, len(width))
    jump = np.append(jump, len(width))
    at = np.zeros(1, np.int64)
    while len(at) < n:  # jump is 2**k steps; the first 2**k positions are known
        at = np.concatenate([at, jump[at]])
        if len(at) < n:
            jump = jump[jump]
    return at[:n]


def word_key(h: np.ndarray) -> np.ndarray:
    """16 bits of a word's hash; a bucket is a range of them."""
    return (h >> tk.U64(48)).astype(np.uint16)


class _Chunk:
    """What one chunk has gathered."""

    def __init__(self) -> None:
        self.keys: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.hashes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.bytes = 0

    def add(self, doc_ids: pa.Array, buf: np.ndarray, offs: np.ndarray) -> None:
        starts, ptr = tk.pretokens(buf, offs)
        self.doc_ids.append(doc_ids)
        self.counts.append(np.diff(ptr))
        self.bytes += len(buf)
        if not len(starts):
            return
        ends = np.append(starts[1:], len(buf))
        codes, first = tk.distinct(buf, starts, ends)
        raw = buf.tobytes()
        found = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        new = [i for i, w in enumerate(found) if w not in self.keys]
        if new:
            self.keys.update(zip((found[i] for i in new), range(len(self.words), len(self.words) + len(new))))
            self.words += [found[i] for i in new]
            self.hashes.append(tk.hash_ranges(buf, starts[first[new]], ends[first[new]]))
        self.codes.append(np.fromiter(map(self.keys.__getitem__, found), np.int32, len(found))[codes])

    def row(self, key: int) -> pa.RecordBatch:
        codes, hashes = _join(self.codes, np.int32), _join(self.hashes, tk.U64)
        often = np.bincount(codes, minlength=len(self.words))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        buckets = word_key(hashes[order])
        # words lie in the order of their keys, in rank order within each
        by_bucket = order[np.argsort(buckets, kind="stable")]
        words = [self.words[i] for i in by_bucket.tolist()]
        lengths = np.fromiter(map(len, words), np.uint32, len(words))
        doc_ids = pa.concat_arrays([x.cast(pa.int64()) for x in self.doc_ids])
        values = [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)]
        values += [pa.array([x], pa.binary()) for x in (_join(self.counts, np.int64).astype("<u4").tobytes(), pack(rank[codes]), b"".join(words), lengths.astype("<u4").tobytes(), buckets.astype("<u2").tobytes())]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "doc_ids", "counts", "sequence", "words", "lengths", "buckets"])


def chunk_rows(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, _Chunk()
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                held.add(b.column("doc_id").slice(first, last - first), buf, offs)
                if held.bytes >= chunk_bytes:
                    yield held.row((part << 32) + n)
                    n, held = n + 1, _Chunk()
        if held.doc_ids:
            yield held.row((part << 32) + n)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


def _asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks to a row for each of ``2 ** bits`` buckets of words that a chunk holds."""
    for b in batches:
        for chunk, words, lengths, buckets in zip(*(b.column(c) for c in ("chunk", "words", "lengths", "buckets"))):
            sizes = np.frombuffer(lengths.as_buffer(), "<u4")
            # the keys are those of the ranks; words stand in the order of keys
            count = np.bincount(np.frombuffer(buckets.as_buffer(), "<u2") >> (16 - bits), minlength=1 << bits)
            stop = np.cumsum(count)
            ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
            raw = words.as_buffer().to_pybytes()
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(has, pa.int32()),
                "chunk": pa.array([chunk.as_py()] * len(has), pa.int64()),
                "words": pa.array([raw[ends[stop[i] - count[i]] : ends[stop[i]]] for i in has], pa.binary()),
                "lengths": pa.array([pack(sizes[stop[i] - count[i] : stop[i]]) for i in has], pa.binary()),
                "n": pa.array(count[has], pa.int32()),
            })


@lru_cache(maxsize=2)
def _pieces(vocabulary: str):  # noqa: ANN202
    return bpe.Encoder(vocabulary).piece


def encode_words(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """(chunk, bucket, counts, ids): the ids of each chunk's words, each distinct word encoded once.

    Ids take two bytes if the vocabulary has no more than 65536, else four. A task holds the
    distinct words of one bucket at a time, and no more than ``KNOWN_WORDS`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, wide = _pieces(vocabulary), _wide(vocabulary)
        now, known = -1, {}
        for b in batches:
            out_counts, out_ids = [], []
            for bucket, words, lengths, n in zip(b.column("bucket").to_pylist(), b.column("words"), b.column("lengths"), b.column("n").to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                raw, ends = words.as_buffer().to_pybytes(), np.append(0, np.cumsum(unpack(lengths.as_buffer().to_pybytes(), n))).tolist()
                ids = []
                for a, e in zip(ends, ends[1:]):
                    w = raw[a:e]
                    got = known.get(w)
                    if got is None:
                        if len(known) >= KNOWN_WORDS:  # bounds memory: a word may then be encoded again
                            known = {}
                        got = known[w] = np.array(piece(w), wide).tobytes()
                    ids.append(got)
                out_counts.append(pack(np.fromiter(map(len, ids), np.int64, n) // np.dtype(wide).itemsize))
                out_ids.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("bucket"), b.column("n"), pa.array(out_counts, pa.binary()), pa.array(out_ids, pa.binary())], names=["chunk", "bucket", "n", "counts", "ids"])

    total = chunks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    buckets = min(max(total // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1])
    bits = (buckets - 1).bit_length()
    asked = chunks.select("chunk", "words", "lengths", "buckets").mapInArrow(lambda batches: _asked(batches, bits), "bucket int, chunk long, words binary, lengths binary, n int")
    met = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return met.mapInArrow(run, "chunk long, bucket int, n int, counts binary, ids binary")


def _wide(vocabulary: str) -> str:
    return "<u2" if max(bpe.encoder(vocabulary).ranks.values()) < 1 << 16 else "<u4"


def encode(docs: DataFrame, vocabulary: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_ids, counts, ids, id_counts), a row for each chunk: ids of all texts in order, packed.

    ``unpack_documents`` makes rows of them.
    """
    spark = docs.sparkSession
    name, path = f"bpe_chunks_{uuid.uuid4().hex}", scratch.new_folder(spark, "bpe-chunks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch.hold_table(spark, name)
    chunk_rows(docs, chunk_bytes).write.bucketBy(buckets, "chunk").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    replies = encode_words(chunks, vocabulary).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "counts", "ids"))).alias("replies"))
    # a chunk without any word has no reply
    return chunks.select("chunk", "doc_ids", "counts", "sequence", "buckets").join(replies, "chunk", "left")


def documents(encoded: DataFrame, vocabulary: str, work, schema: str) -> DataFrame:  # noqa: ANN001
    """Apply ``work(doc_ids, ids, starts)`` to every chunk: ids of its documents in order and where each begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _wide(vocabulary)
        for b in batches:
            for i in range(b.num_rows):
                counts = np.frombuffer(b.column("counts")[i].as_buffer(), "<u4").astype(np.int64)
                buckets = np.frombuffer(b.column("buckets")[i].as_buffer(), "<u2")
                sequence = unpack(b.column("sequence")[i].as_buffer().to_pybytes(), int(counts.sum()))
                sizes, pool = [np.zeros(0, np.int64)], []
                for r in b.column("replies")[i].values or []:
                    sizes.append(unpack(r["counts"].as_buffer().to_pybytes(), r["n"].as_py()))
                    pool.append(np.frombuffer(r["ids"].as_buffer(), wide))
                size = np.concatenate(sizes)
                pool = np.concatenate(pool).astype(np.uint32) if pool else np.zeros(0, np.uint32)
                if len(size) != len(buckets):
                    raise ValueError("a chunk's words and their ids differ in number")
                by_bucket = np.argsort(buckets, kind="stable")
                offs, lens = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
                offs[by_bucket], lens[by_bucket] = np.cumsum(size) - size, size
                n_of = lens[sequence]
                total = np.append(0, np.cumsum(n_of))
                ids = bpe.gather(offs[sequence], n_of, pool)
                yield work(b.column("doc_ids")[i].values, ids, total[np.append(0, np.cumsum(counts))])

    return encoded.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _tables(vocabulary: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    data, offs = bpe.byte_table(bpe.encoder(vocabulary).ranks)
    return (data, offs), bpe.decimal_table(len(offs) - 1)


def decode(ids: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the documents' ids and where each document's begin."""
    data, offs = table
    lens = (offs[1:] - offs[:-1])[ids]
    return bpe.gather(offs[ids], lens, data), np.append(0, np.cumsum(lens))[starts]


def digests(docs: DataFrame, vocabulary: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, the last from decoded ids."""

    def work(doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        table, decimals = _tables(vocabulary)
        ids_sha, text_sha = [], []
        step = max(1, int(np.searchsorted(starts, 1 << 18)))
        for a in range(0, len(doc_ids), step):
            e = min(len(doc_ids), a + step)
            own, at = ids[starts[a] : starts[e]], starts[a : e + 1] - starts[a]
            for out, (data, cuts), cut in ((ids_sha, decode(own, at, decimals), 1), (text_sha, decode(own, at, table), 0)):
                view = memoryview(data)
                out += [hashlib.sha256(view[x : max(x, y - cut)]).hexdigest() for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(starts), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(encode(docs, vocabulary, chunk_bytes), vocabulary, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocabulary: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and the ids of its text."""

    def work(doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return documents(encode(docs, vocabulary, chunk_bytes), vocabulary, work, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text (binary) of (doc_id, ids array<int>); null ids stay null, an unknown id raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tables(vocabulary)[0]
        for b in batches:
            lists = b.column("ids")
            text = [None if x is None else decode(np.array(x, np.int64), np.array([0, len(x)]), table)[0].tobytes() for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.binary())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, T.StructType([tokens.schema["doc_id"], T.StructField("text", T.BinaryType())]))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

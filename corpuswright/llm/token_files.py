"""Token ids in Arrow files of fixed-size-list batches, written and read back.

Format. A data set is a folder of Arrow IPC files, one for each range of document ids, in
ascending order of the ids. A file is a sequence of record batches whose rows are sequences of
``sequence_length`` ids: column ``input_ids`` is a fixed-size list of unsigned integers (16 bits if
the vocabulary fits, else 32), ``mask`` tells the positions that hold a token, ``begins`` those where
a document begins; both are fixed-size lists of booleans, that is, bits. Documents follow each
other without gaps across sequences; only a file's last sequence has empty positions, at its end.
No buffer is compressed, so a memory map gives any sequence or mask without copying. The ids of the
documents, in order, are in a column of a second Arrow file next to the first (``.docs.arrow``).

Documents of every source or group are dealt out by ranges of the id, so that no group meets in
one task. Files have the attempt in their name; the manifest, a table in the shared folder, has those of committed
attempts only, so a task that runs twice, or whose executor is lost, does no harm.

Defined results: a null or empty text has only the end id; a null doc_id sorts first; repeated ids
are ordered by text, and equal rows each have their own ids; an empty table gives no files. Other
columns of the input are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, scratch
from . import textkit as tk

MANIFEST = "part int, file string, n_docs long, n_tokens long, n_sequences long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Packer:
    """Writes one file: ids are packed into sequences, sequences into batches."""

    def __init__(self, sink: pa.NativeFile, docs_sink: pa.NativeFile, length: int, id_type: pa.DataType, batch_sequences: int) -> None:
        self.length, self.id_type, self.room = length, id_type, length * batch_sequences
        self.schema = pa.schema([("input_ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length)), ("begins", pa.list_(pa.bool_(), length))], {"sequence_length": str(length)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.docs = pa.ipc.new_file(docs_sink, pa.schema([("doc_id", pa.int64())]))
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.held = self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray) -> None:
        """Documents' ids, each with its end id, and where each document begins in them."""
        marks = np.zeros(len(ids), bool)
        marks[starts] = True
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["doc_id"]))
        self.ids.append(ids)
        self.marks.append(marks)
        self.held += len(ids)
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        while self.held >= self.room:
            self._flush(self.room)

    def _flush(self, n: int) -> None:
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        self.ids, self.marks, self.held = [ids[n:]], [marks[n:]], len(ids) - n
        rows = -(-n // self.length)
        pad = rows * self.length - n
        lists = [np.append(ids[:n], np.zeros(pad, ids.dtype)), np.append(np.ones(n, bool), np.zeros(pad, bool)), np.append(marks[:n], np.zeros(pad, bool))]
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, kind), self.length) for x, kind in zip(lists, (self.id_type, pa.bool_(), pa.bool_()))]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.out.close()
        self.docs.close()


def ranged(docs: DataFrame) -> DataFrame:
    """Rows in order of id and text, in ranges; rows of one id are spread by how their texts begin."""
    return docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, sequence_length: int = 2048, batch_sequences: int = 128, added_tokens: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the files in ascending id order; the manifest, a row for each file.

    With ``added_tokens`` the literal text of one of the file's added tokens is that token, as the
    tokenizers library has it by default; without, it is text like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        part = TaskContext.get().partitionId()
        enc = bpe.encoder(vocabulary)
        small = max([*enc.ranks.values(), *enc.added.values(), end_id]) < 1 << 16
        fs, inner = scratch.file_system(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        own, final = f"{inner}/.{name}", f"{inner}/{name}"
        sinks = []
        for b in batches:
            if packer is None and b.num_rows:
                fs.create_dir(inner, recursive=True)
                sinks = [fs.open_output_stream(own + end) for end in (".arrow", ".docs.arrow")]
                packer = Packer(*sinks, sequence_length, pa.uint16() if small else pa.uint32(), batch_sequences)
            for first, last, buf, offs in tk.blocks(b.column("text")):
                ids, ptr = (enc.encode_with_added if added_tokens else enc.encode)(buf, offs)
                ids = np.insert(ids, ptr[1:], end_id).astype(np.uint16 if small else np.uint32)
                packer.add(b.column("doc_id").slice(first, last - first), ids, ptr[:-1] + np.arange(last - first))
        if packer is not None:
            packer.close()
            for sink, end in zip(sinks, (".arrow", ".docs.arrow")):
                sink.close()
                fs.move(own + end, final + end)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [packer.n_docs], "n_tokens": [packer.n_tokens], "n_sequences": [packer.n_sequences]})

    return scratch.cut(ranged(docs).mapInArrow(run, MANIFEST), "token-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    The driver adds up the files' totals, a row for each file; ids stay on the executors.
    """
    files, base = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r.file, base))
        base += r.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = scratch.file_system(folder)
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with fs.open_input_file(f"{inner}/{file}.docs.arrow") as f:
                    doc_ids = pa.ipc.open_file(f).read_all()["doc_id"].combine_chunks()
                with fs.open_input_file(f"{inner}/{file}.arrow") as f:
                    yield from _documents(pa.ipc.open_file(f), doc_ids, start)

    if not files:
        return spark.createDataFrame([], RESULT)
    rows = spark.sparkContext.parallelize(files, len(files))
    return spark.createDataFrame(rows, "file string, base long").mapInArrow(run, RESULT)


def _documents(source: pa.ipc.RecordBatchFileReader, doc_ids: pa.Array, base: int) -> Iterator[pa.RecordBatch]:
    """The documents of a file; what a batch holds of its last document waits for the next batch."""
    rest, at, done = np.zeros(0, np.uint32), 0, 0
    for i in range(source.num_record_batches):
        batch = source.get_batch(i)
        ids, mask, begins = (c.values for c in (batch.column("input_ids"), batch.column("mask"), batch.column("begins")))
        n = mask.true_count
        ids = np.concatenate([rest, ids.to_numpy()[:n].astype(np.uint32)])
        cuts = len(rest) + np.flatnonzero(begins.to_numpy(zero_copy_only=False)[:n])
        cuts = cuts if not len(rest) else np.insert(cuts, 0, 0)
        last = i == source.num_record_batches - 1
        ends = np.append(cuts[1:], len(ids)) if last else cuts[1:]
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, ends)]
        m = len(ends)
        yield pa.RecordBatch.from_arrays([doc_ids.slice(done, m), pa.array(base + at + cuts[:m], pa.int64()), pa.array(ends - cuts[:m], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        done += m
        stop = int(ends[-1]) if m else 0
        at, rest = at + stop, ids[stop:]


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_folder(spark, "token-files")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder, added_tokens=True)
    return read(spark, folder, manifest)

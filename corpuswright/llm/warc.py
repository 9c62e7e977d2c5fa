"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing makes gzip-per-record WARC 1.1 files and, for every record, a row of an index: file,
offset, length, URL and digest. Of records with equal payloads of at least ``revisit_bytes`` the one
with the largest id holds the payload (``response``), the others refer to it (``revisit``). Payloads
are told apart by SHA-1 and length.

Reading starts from selected rows of the index. Their ranges are sorted by file and offset, and
neighbours are coalesced into one read while the gap between them is small and the read is not too
long. Every payload that is read is checked against its digest.

Digests of copies are aggregated before they are shuffled; only groups of two or more are joined
back to the pages, in a join whose hot keys adaptive execution splits. Pages too short to be
revisited pass without a shuffle. A file's name tells the attempt that wrote it, and the index, a table in the shared folder, has the names of
committed attempts only: lost executors leave no gap, and a second attempt can't replace a file that is indexed.

Defined results: a null html is an empty payload; a null url is recorded as ``urn:page:<id>`` and
is null in the index; control characters and spaces in a url are percent-encoded in the archive
only; a null page_id never is the larger one and no other record refers to it; rows that repeat the
largest page_id of a group are responses all; an empty table gives no archive. Columns beside
page_id, url and html are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Date of capture: pages carry none, and archives of equal pages should be equal.
DATE = "1970-01-01T00:00:00Z"


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload, payload_digest (hex), payload_bytes and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    long_enough = pages.where(F.octet_length("html") >= revisit_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").cast("long").alias("b"))
    groups = long_enough.groupBy("d", "b").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    short = base.where(F.col("payload_bytes") < revisit_bytes).withColumn("refers_to", F.lit(None).cast("long"))
    joined = base.where(F.col("payload_bytes") >= revisit_bytes).join(groups, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    return short.unionByName(joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to")))


def _uri(page_id: int | None, url: str | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page-record:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page-record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is None:
        lines.append("X-No-Target: 1")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if len(block) != int(warc["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) to ``folder``; their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = scratch.file_system(folder)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        n, out, at = 0, None, 0
        for b in batches:
            rows = []
            for page_id, url, payload, digest, size, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"))):
                if out is None:
                    fs.create_dir(inner, recursive=True)
                    out, at = fs.open_output_stream(f"{inner}/.{own}", compression=None), 0
                data = record(page_id, url, payload, digest, refers)
                out.write(data)
                rows.append((f"part-{part:06d}-{n:04d}-{own}.warc.gz", at, len(data), page_id, url, digest, size, "response" if refers is None else "revisit", refers))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    fs.move(f"{inner}/.{own}", f"{inner}/{rows[-1][0]}")
                    n, out = n + 1, None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)
        if out is not None:
            out.close()
            fs.move(f"{inner}/.{own}", f"{inner}/part-{part:06d}-{n:04d}-{own}.warc.gz")

    return scratch.cut(with_record_types(pages, revisit_bytes).mapInArrow(run, INDEX), "warc-index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]


def ranges(index: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """(file, start, stop, records): coalesced reads of the index's rows.

    A file is cut into windows of ``read_bytes`` by record offset, so that a read and the rows that
    belong to it are bounded; within a window, records further apart than ``gap_bytes`` are read apart.
    """
    rows = index.select("file", F.floor(F.col("offset") / read_bytes).alias("window"), "offset", "length").distinct()
    near = Window.partitionBy("file", "window").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(near) > gap_bytes
    runs = rows.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("apart").over(near))
    reads = runs.groupBy("file", "window", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return reads.select("file", "start", "stop", "records")


def read(index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index's rows name, from the archives alone.

    A revisit has a null payload; digest and length are those of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = scratch.file_system(folder)
        for b in batches:
            for file, start, stop, records in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop", "records"))):
                with fs.open_input_file(f"{inner}/{file}") as f:
                    data = f.read_at(stop - start, start)
                rows = []
                for r in records:
                    warc, http, payload = parse(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = warc["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    rows.append((_id(warc["WARC-Record-ID"]), None if "X-No-Target" in warc else warc["WARC-Target-URI"], kind, _id(warc.get("WARC-Refers-To")), digest, int(http["Content-Length"]), payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in RECORD.split(", ")])

    # the index is small beside the archives: without a number of its own, one task would read them all
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges(index, read_bytes, gap_bytes).repartition(spread).mapInArrow(run, RECORD)


def _id(uri: str | None) -> int | None:
    value = uri and uri[len("<urn:page-record:") : -1]
    return int(value) if value and value != "None" else None


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_folder(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m
"""

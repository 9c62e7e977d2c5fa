import gzip
import hashlib

import pyarrow.fs as pafs

from corpuswright.llm import scratch, warc


def plain(rows, least=1000):
    largest = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and i is not None:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        refers = largest.get(p) if p in largest and (i is None or i < largest[p]) else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert digest(warc.op2_warc(spark, sf_dir)) == plain(rows)


def test_odd_rows_and_selected_reads(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", big), (3, "http://c", big), (4, "u", None), (5, "v", ""), (6, "w", "short"), (7, "w", "short"), (None, "n", big), (8, "x\r\ny", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as payload", "1 as offset").repartition(3)
    folder = scratch.new_folder(spark, "warc")
    index = warc.write(pages, folder, file_bytes=300)
    got = warc.read(index, folder)
    assert digest(got) == plain(rows)
    assert {(r.page_id, r.url) for r in got.collect()} == {(1, "http://a/%20b"), (2, None), (3, "http://c"), (4, "u"), (5, "v"), (6, "w"), (7, "w"), (None, "n"), (8, "x%0D%0Ay")}
    assert {r.page_id: bytes(r.payload) for r in got.where("page_id in (6, 8)").collect()} == {6: b"short", 8: b"z" * 200_000}
    few = index.where("page_id in (2, 7)")
    for read_bytes, gap in ((1, 0), (10_000, 10), (1 << 20, 1 << 20)):
        assert sorted(r.page_id for r in warc.read(few, folder, read_bytes, gap).collect()) == [2, 7]
    fs, inner = pafs.FileSystem.from_uri(folder)
    for f in fs.get_file_info(pafs.FileSelector(inner)):
        with fs.open_input_file(f.path) as x:
            assert gzip.decompress(x.read()).startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert warc.read(warc.write(pages.limit(0), scratch.new_folder(spark, "warc")), folder).count() == 0


def test_neighbours_are_read_together(spark):
    folder = scratch.new_folder(spark, "warc")
    index = warc.write(spark.range(100).selectExpr("id as page_id", "'u' as url", "'x' as html").coalesce(1), folder)
    assert warc.ranges(index).count() == 1
    assert warc.ranges(index.where("page_id % 2 = 0"), gap_bytes=0).count() == 50

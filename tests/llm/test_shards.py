import zlib
from collections import Counter, defaultdict

import duckdb

from corpuswright.llm import scratch, shards


def plain(rows, n):
    rows = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, slots, out = sum(r[1] for r in rows), 0, Counter(), []
    for i, size, crc in rows:
        s = min(n - 1, n * (2 * at + size) // (2 * total))
        out.append((i, size, crc, s, slots[s]))
        slots[s] += 1
        at += size
    return sorted(out, key=str)


def test_query_equals_plain_prefix_sums(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = shards.op3_sharding(spark, sf_dir)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()), key=str) == plain(rows, 24)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(((r[0], r[1], r[2], r[4], r[5]) for r in c.execute(shards.OP3_SQL).fetchall()), key=str) == plain(rows, 24)
    assert {(r.law, r.grown_shard) for r in got.select("law", "grown_shard").distinct().collect()} == {("bytes", None)}


def test_shards_are_even(spark):
    got = shards.op3_sharding(spark, "/root/testdata/sf0.1").collect()
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r.size
    mean, most = sum(load.values()) / 24, max(r.size for r in got)
    assert sorted(load) == list(range(24)) and all(abs(x - mean) <= most for x in load.values())


def test_odd_tables(spark):
    rows = [(None, "x"), (None, None), (1, ""), (2, "é" * 9000), (2, "same"), (2, "same"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as part").repartition(3)
    for n in (1, 3, 24):
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.assign(docs, n).collect()), key=str) == plain(rows, n)
    assert shards.assign(docs.limit(0)).count() == 0


def test_written_shards(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "repeat('x', cast(id as int)) as text")
    path = scratch.new_folder(spark, "shards")
    placed = shards.write(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in placed.collect())


def test_one_id_on_many_rows(spark):
    rows = [(7, "x" * (i % 50)) for i in range(500)] + [(None, "y" * i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.assign(docs, 5).collect()), key=str) == plain(rows, 5)

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpuswright.llm import resample, skew

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, p):
    words = WORD.findall((text or "").translate(LOWER))
    found = [" ".join(words[i : i + n]) for n in range(1, p.longest_run + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(x.encode()) % p.buckets for x in found)


def plain(docs, target, p=resample.Params()):
    made = [(i, *runs(t, p)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in made:
        s.update(c)
    for x in target:
        t.update(runs(x, p)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets)))) for b in range(p.buckets)]
    rows = []
    for i, n, c in made:
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= p.min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {}
    for at, r in enumerate(able[: p.percent * len(able) // 100], 1):
        rank.setdefault(r, []).append(at)
    return sorted(((*r, rank[r].pop() if rank.get(r) else None) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_crc_equals_zlib():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 700)
    ends = starts + rng.integers(0, 100, 700)
    assert resample.crc32_ranges(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resample.crc32_ranges(buf, starts[:0], ends[:0]).tolist() == []


@pytest.mark.parametrize("p", [resample.Params(), resample.Params(longest_run=3, buckets=97, min_words=5, percent=33, seed="x")])
def test_equals_brute_force(spark, p):
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "été", "x1", "日本", "w" * 70, "don't", "a-b"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)]
    docs = [(i, rng.choice(texts)) for i in range(900)]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(10)] + [None]
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([(x,) for x in target], "text string"), p)
    assert got(found) == plain(docs, target, p)


def test_odd_rows(spark):
    rows = [(None, None), (None, "one two"), (1, ""), (2, "...\n"), (3, "word " * 30), (3, "word " * 30), (4, "word " * 30), (5, "é" * 100_000), (6, "A b C " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as copies", "3 as part", "4 as place", "5 as RANK", "6 as weight")
    target = spark.createDataFrame([("word a",)], "text string")
    half = resample.Params(percent=60)
    assert got(resample.resample(docs, target, half)) == plain(rows, ["word a"], half)
    assert got(resample.resample(docs, target.limit(0))) == plain(rows, [])
    assert resample.resample(docs.limit(0), target).count() == 0


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    found = got(resample.op11_resample(spark, sf_dir))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert found == sorted((tuple(r) for r in c.execute(resample.OP11_SQL).fetchall()), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert found == sorted(((i, n, w, s, r) for i, _, n, w, s, r in plain(docs, target)), key=str)


def test_facts_meet_all_rows_whatever_the_share_of_a_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for most in (1, 3, 4096):
        assert skew.join_facts(rows, facts, "k", "n", 3000, most).select("id").distinct().count() == 3000
        assert skew.join_facts(rows, facts, "k", "n", 3000, most).count() == 3000

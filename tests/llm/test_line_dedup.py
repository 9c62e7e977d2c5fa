import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def plain(rows, p=line_dedup.Params()):
    held = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= p.min_chars:
                held[k].append(doc_id)
    owner = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= p.min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"Common LINE number {i} with Ünïcode and enough characters" for i in range(40)] + ["é" * 40, "é" * 39, " " + "b" * 39, "short"]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.3 else f"own line {i} {rng.random()} of some length, more or less" for _ in range(rng.randrange(12))]
        lines = [rng.choice(["", " ", "\t"]) + x + rng.choice(["", "  ", "\r", "\x0b\x0c"]) for x in lines]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines)))
    return rows


@pytest.mark.parametrize("p", [line_dedup.Params(), line_dedup.Params(batches=7, fanout=3, min_docs=2), line_dedup.Params(batches=1), line_dedup.Params(batches=5, fanout=2, min_docs=1, min_chars=1)])
def test_equals_brute_force(spark, p):
    rows = corpus(1, 300)
    found = got(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), p))
    assert found == plain(rows, p) and sum(r[2] for r in found) > 100


def test_odd_rows(spark):
    same = "this very same line stands in a lot of documents"
    dup = "that line is repeated within and across documents"
    rows = [(None, same), (None, None), (1, ""), (2, same + "\n" + same), (3, "\n"), (4, same), (5, dup + "\n\n" + dup), (6, same.upper() + " "), (7, "x" * 300_000 + "\n" + dup), (9, f"{same}\n{dup}\nend"), (9, f"{same}\n{dup}\nend"), (9, f"{same}\nother"), (8, same + "\r\n" + dup)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as owner", "4 as TAG", "'d' as dropped")
    assert got(line_dedup.dedup(docs)) == plain(rows)
    nulls = [(None, same)] * 6
    assert got(line_dedup.dedup(spark.createDataFrame(nulls, "doc_id long, text string"))) == plain(nulls)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_runs_are_merged_without_a_shuffle_and_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    rng, batches = random.Random(3), []
    for b in range(5):
        pairs = {(1000 - 100 * b - rng.randrange(100), b"%d" % rng.randrange(60)) for _ in range(80)}
        batches.append(pairs)
        run = runs.add(spark.createDataFrame(sorted(pairs), "doc_id long, key binary"))
        before = {k for x in batches[:-1] for _, k in x}
        assert b in (1, 3) or all((r.owner is None) == (bytes(r.key) in before) for r in run.collect())  # these were compacted at once
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = runs.merged()
    want = {k: (sum(k == x for s in batches for _, x in s), max(i for s in batches for i, x in s if x == k)) for s in batches for _, k in s}
    assert {bytes(r.key): (r.n, r.owner) for r in merged.collect()} == want
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_one_hot_line_is_not_shuffled_by_itself(spark):
    hot = "one line that a third of all of the documents hold"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("a line that nobody else has, with its number "), "id")).alias("text"))
    out = line_dedup.dedup(docs)
    assert out.where("n_dropped = 1").count() == 999 and out.where("doc_id = 2997 and n_dropped = 0").count() == 1


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    found = sorted(tuple(r) for r in line_dedup.op13_line_dedup(spark, sf_dir).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert found == sorted(tuple(r) for r in c.execute(line_dedup.OP13_SQL).fetchall())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found == sorted(plain(rows))

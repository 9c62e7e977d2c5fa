"""Folds of arrays in expressions: longest common subsequences and batches under a budget."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import scoring
from corpuswright.operators import batching


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j] + 1 if x == y else row[j + 1]))
        row = new
    return row[-1]


def test_common_length_equals_the_recurrence(spark):
    rng = random.Random(1)
    words = lambda n, k: [rng.choice("abcdefghij"[:k]) for _ in range(n)]
    sizes = [0, 1, 2, 5, 61, 62, 63, 124, 125, 200]
    pairs = [(words(rng.choice(sizes), k), words(rng.choice(sizes), k)) for k in (1, 2, 4, 10) for _ in range(40)] + [(["a"] * 300, ["a"] * 300), (["a"], []), ([], ["a"])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.n for r in df.select("i", scoring.common_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [got[i] for i in range(len(pairs))] == [common(a, b) for a, b in pairs]


def test_rouge_l_runs_without_python(spark):
    df = spark.createDataFrame([("red green blue gold", "green red gold"), (None, "x"), ("", "")], "a string, b string").select(scoring.rouge_l(F.col("a"), F.col("b")).alias("r"))
    assert [round(r.r, 9) for r in df.collect()] == [round(4 / 7, 9), 0.0, 0.0]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def packed(rows, budget, multiple):
    out, batch, longest, held = [], 0, 0, 0
    for n, i in sorted((n, i) for i, n in rows):
        size = -(-n // multiple) * multiple
        if held and max(longest, size) * (held + 1) > budget:
            batch, longest, held = batch + 1, 0, 0
        longest, held = max(longest, size), held + 1
        out.append((batch, i, n))
    return sorted(out)


@pytest.mark.parametrize("budget, multiple", [(512, 8), (4096, 8), (300, 1), (1 << 40, 64)])
def test_pack_equals_a_loop(spark, budget, multiple):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 7, 8, 9, rng.randrange(1, 290)])) for i in range(700)]
    df = batching.pack(spark.createDataFrame(rows, "id long, length int").repartition(3), budget, multiple, pool_batches=5)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    pools = {}
    for r in df.collect():
        pools.setdefault(r.pool, []).append((r.batch, r.id, r.length))
    lengths = dict(rows)
    assert sum(map(len, pools.values())) == 700
    for got in pools.values():
        assert sorted(got) == packed([(i, lengths[i]) for _, i, _ in got], budget, multiple)


def test_pack_of_nothing(spark):
    assert batching.pack(spark.createDataFrame([], "id long, length long"), 100).count() == 0

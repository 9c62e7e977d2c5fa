import os

import duckdb
import pandas as pd
import pytest

from corpuswright.plans import answer_queries, build_queries, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_benchmark_item_meets_documents(spark, tmp_path):
    items = [(5, "the first"), (9, "der zweite"), (70, "les uns"), (10**6, "de cuatro")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r["item"]) for r in answer_queries._doc_items(spark, str(tmp_path)).collect())
    assert got == [(i, items[i % 4][1]) for i in range(9)]
    large = "/root/testdata/sf0.1"
    want = {r.item_id for r in spark.read.parquet(f"{large}/benchmark.parquet").collect()}
    met = answer_queries._doc_items(spark, large).groupBy("item_id").count().collect()
    assert len(want) > 40 and {r.item_id for r in met} == want
    assert sum(r["count"] for r in met) == spark.read.parquet(f"{large}/documents.parquet").count()


def test_worst_packed_batches_equal_brute_force(spark):
    batches = {}
    for r in build_queries.token_budget_batches(spark, SF).collect():
        batches.setdefault((r.pool, r.batch), []).append(r.length)
    made = [(p, b, len(x), max(x), -(-max(x) // 8) * 8 * len(x)) for (p, b), x in batches.items()]
    first = lambda at: min(made, key=lambda r: (-r[at], r[0], r[1]))
    got = sorted((r.pool, r.batch, r["size"], r.longest, r.cost) for r in registry.QUERIES["worst_packed_batches"](spark, SF).collect())
    assert len(made) > 10 and got == sorted({first(4), first(3)})

import zlib

import numpy as np
import pyarrow as pa

from corpuswright.llm import quality_knn as q
from corpuswright.llm import quality_rules


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = q.op9_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    pdf = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (pdf.held_out == pdf.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert ((pdf.score >= 0) & (pdf.score <= 1)).all() and (pdf.predicted == (pdf.score >= 0.7)).all()
    out = pdf[pdf.held_out]
    assert (out.predicted == out.quality).mean() > 0.97
    assert out[out.quality == 1].predicted.mean() > 0.98


def test_labels_of_held_out_rows_have_no_effect(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", q.F.when(q.held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in q.score(docs, q.fit(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = pa.array([" ".join(rng.choice(words, 12)) for _ in range(60)] + ["", None])
    p = q.Params(terms=64, dims=8, neighbours=7, block_rows=13)
    quality = (np.arange(62) % 3 > 0).astype(int)
    m = q.fit_model(q.term_counts(texts, p.terms), quality, p)
    got = m.scores(texts)
    v = m.embed(texts)
    for i in range(62):
        near = np.maximum(m.vectors @ v[i], 0)
        top = np.argsort(-near, kind="stable")[:7]
        w = near[top] ** p.sharpness
        good, bad = (w * m.good[top]).sum(), (w * m.bad[top]).sum()
        want = m.prior if good + bad == 0 else good / (good + bad)
        assert abs(got[i] - want) < 1e-3
    assert got[60] == got[61] == m.prior


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string").selectExpr("*", "'x' as score", "5 as predicted")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(docs, none) is None
    assert [r.score for r in q.score(docs, None).collect()] == [0.5] * 5
    one = q.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int"))
    assert q.score(docs, one).count() == 5 and q.score(docs.limit(0), one).count() == 0
    assert q.stage(spark, docs, none).columns == docs.columns


def test_bad_rows_that_the_rules_let_through_are_learnt_from(spark):
    """The labels table holds many more bad ids than the limit of a class, and most aren't in the stage's input."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # letters changed one for one: the rules' counts stay as they are
    turned = q.F.translate("text", "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
    planted = docs.where("doc_id % 5 = 0").withColumn("text", turned).withColumn("doc_id", q.F.col("doc_id") + 1_000_000)
    kept = quality_rules.stage(spark, docs.unionByName(planted), labels)
    bad = planted.where("doc_id % 2 = 0").selectExpr("doc_id", "0 as quality")
    gone = spark.range(2_000_000, 2_060_000).selectExpr("id as doc_id", "0 as quality")
    known = labels.select("doc_id", "quality").unionByName(bad).unionByName(gone)
    want = {r.doc_id for r in bad.join(kept, "doc_id", "left_semi").where(~q.held_out(q.F.col("doc_id"))).collect()}
    assert len(want) > 40
    model = q.fit(kept, known)
    assert (model.bad > 0).sum() == len(want)
    left = {r.doc_id for r in q.stage(spark, kept, known).select("doc_id").collect()}
    before = {r.doc_id for r in kept.select("doc_id").collect()}
    unseen = {i for i in before if i >= 1_000_000} - want
    assert len(unseen) > 40 and len(unseen & left) < 0.1 * len(unseen)
    good = {i for i in before if i < 1_000_000}
    assert len(good & left) > 0.97 * len(good)


def test_a_repeated_id_takes_one_place_in_the_sample(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    hot = labels.where(~q.held_out(q.F.col("doc_id"))).orderBy("doc_id").first().doc_id
    copies = docs.where(f"doc_id = {hot}").crossJoin(spark.range(5000)).drop("id")
    a, b = q.fit(docs, labels), q.fit(docs.unionByName(copies), labels)
    assert len(a.vectors) == len(b.vectors) and (b.good > 0).any() and (b.bad > 0).any()
    assert np.array_equal(a.good, b.good) and np.allclose(a.vectors, b.vectors)

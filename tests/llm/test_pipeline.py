import random

import corpus_pipeline as c
from corpuswright.llm import quality_knn, quality_rules, scratch

from .test_byte_bpe import expected
from .test_decontaminate import plain as plain_hits
from .test_jaccard_join import plain as plain_groups

SF = "/root/testdata/sf0.01"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, frames = [], [docs]
    for name, stage in c.STAGES:
        made = scratch.cut(stage(spark, frames[-1], SF), "test")
        if name != c.STAGES[-1][0]:
            assert made.schema == docs.schema
        frames.append(made)
        kept.append({r.doc_id for r in made.select("doc_id").collect()})
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:-1]]
    assert kept[0] == {r.doc_id for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept").collect()}
    assert kept[1] == {r.doc_id for r in quality_knn.score(frames[1], quality_knn.fit(frames[1], labels)).where("predicted = 1").collect()}
    assert kept[2] == {r[2] for r in plain_groups(rows[2])}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept[3] == {r[0] for r in plain_hits(rows[3], items) if not r[5]}
    last = sorted((tuple(r) for r in frames[-1].collect()), key=str)
    assert last == expected(rows[4])
    # here the rules leave nothing for the classifier to drop: see the next test
    assert len(docs.collect()) > len(kept[0]) >= len(kept[1]) > len(kept[2]) > len(kept[3]) > 500
    assert sorted((tuple(r) for r in c.run(spark, SF).collect()), key=str) == last


def test_classifier_stage_drops_what_it_rejects(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in c.STAGES[1][1](spark, docs, SF).collect()}
    judged = quality_knn.score(docs, quality_knn.fit(docs, labels)).collect()
    assert kept == {r.doc_id for r in judged if r.predicted == 1}
    assert 0 < len(judged) - len(kept) < 300


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns of any name; then empty tables."""
    words = [f"w{i}" for i in range(400)]
    text = lambda a, n=120: " ".join(random.Random(a).choices(words, k=n))
    rows = [(1, text(1), 0), (1, text(1), 0), (2, text(1), 1), (3, None, 2), (None, text(2), 3), (4, "", 4), (5, text(3), 5), (5, text(4), 6), (6, text(5) + " " + text(6, 40), 7), (7, text(8, 30_000), 8)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, __rule_kept int").selectExpr("*", "'q' as words", "cast(null as string) as __key", "1 as n_words").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, text(6, 40)), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = docs
    for name, stage in c.STAGES[:-1]:
        made = scratch.cut(stage(spark, made, folder), "test")
        assert made.schema == docs.schema, name
    # null ids stay; of equal texts one row; two texts of one id both; the contaminated one goes
    assert sorted((str(r.doc_id), r.text) for r in made.collect()) == sorted([("1", text(1)), ("None", text(2)), ("5", text(3)), ("5", text(4)), ("7", text(8, 30_000))])
    assert sorted((tuple(r) for r in c.run(spark, folder).collect()), key=str) == expected([(r.doc_id, r.text) for r in made.collect()])
    none = f"{folder}/none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert c.run(spark, none).count() == 0

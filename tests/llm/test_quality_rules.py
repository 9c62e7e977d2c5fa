import re
from collections import Counter

import numpy as np
import pyarrow as pa

from corpuswright.llm import quality_rules as q

from .twins import PAIRS


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


CASES = [None, "", " \n\t ", "a", "a b c a b c", "a b\na b\n a b\n\n\nx\nx", "é日 # $$ <b> é日", "x " * 4000, "a b c d " * 3 + "e", "a\r\nb\r\na\r\n"]


def test_counts_equal_plain_python(spark, sf_dir):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = q.text_counts(pa.array(texts))
    assert got[:, :5].tolist() == [plain(t) for t in texts]


def test_query_is_whole_and_consistent(spark, sf_dir):
    rows = q.op8_quality_rules(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        c = plain(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)


def test_forest_keeps_good_and_rejects_bad(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = q.judge(docs, q.fit(docs, labels)).where("not base_failed").join(labels, "doc_id").select("kept", "quality").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").selectExpr("*", "'x' as kept", "5 as n_words")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(docs, none) is None
    out = q.judge(docs, None).collect()
    assert len(out) == 3 and not any(r.kept for r in out)
    assert q.stage(spark, docs, none).columns == docs.columns
    assert q.judge(docs.limit(0), None).count() == 0


def test_scores_order_outliers_first():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(5, 0.2, 2000), np.zeros(2000), rng.normal(0.96, 0.01, 2000)])
    x[:40] = [8, 2, 0.8]
    f = q.calibrate(q.fit_forest(x, q.Params()), x, np.r_[np.zeros(40), np.ones(1960)], q.Params())
    s = f.scores(x)
    assert (s[:40] > f.limit).all() and (s[40:] > f.limit).mean() <= 0.005


def test_a_repeated_id_takes_one_place_in_the_sample(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    hot = docs.join(labels, "doc_id").where("quality = 1 and n_chars > 600").orderBy("n_chars", "doc_id").first().doc_id
    copies = docs.where(f"doc_id = {hot}").crossJoin(spark.range(5000)).drop("id")
    a, b = q.fit(docs, labels), q.fit(docs.unionByName(copies), labels)
    assert a.limit == b.limit and np.array_equal(a.feature, b.feature) and np.array_equal(a.value, b.value)


def naive_score(forest, ratios):
    """Mean path over the trees, walked node by node, as a share of what is expected."""
    total = 0.0
    for feature, value, path in zip(forest.feature, forest.value, forest.path):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (2 if ratios[feature[node]] >= value[node] else 1)
        total += path[node]
    return 2.0 ** (-total / len(forest.feature) / forest.scale)


def test_verdicts_equal_naive_path_lengths(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = q.fit(docs, labels)
    got = {r.doc_id: r.kept for r in q.op8_quality_rules(spark, sf).collect()}
    rejected = 0
    for r in docs.collect():
        c, words = plain(r.text), re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        n = max(1, c[0])
        high = naive_score(forest, [c[1] / n, c[2] / n, np.log1p(len(set(words))) / np.log1p(n)]) > forest.limit
        assert got[r.doc_id] == (not base and not high)
        rejected += high and not base
    assert rejected > 0


def test_stage_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b " * 40 + " ".join(f"w{i}" for i in range(80)), 7, None), (2, None, 8, "x")], "doc_id long, text string, __rule_kept int, `__RULE_score` string")
    out = q.stage(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and [r[2] for r in out.collect()] == [7]


def test_words_with_equal_sums_of_powers_are_told_apart():
    texts = ["\n".join(pair) for pair in PAIRS] + [" ".join(pair) + " a " + " ".join(pair) for pair in PAIRS]
    counts = q.text_counts(pa.array(texts))
    assert counts[:, :5].tolist() == [plain(x) for x in texts]
    assert counts[:, 5].tolist() == [2] * len(PAIRS) + [3] * len(PAIRS)


def test_labels_of_missing_documents_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert q.labelled_sample(docs, labels, q.Params(sample_rows=50)).count() == 50


def test_every_labelled_row_counts(spark):
    """Forest and limit come from all labelled rows: more than any bounded sample, in any partitioning, and the limit is the local one of all scores."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(rng.choice(words, 60 + int(rng.integers(80)))) + (" #|$ " * int(rng.integers(1, 30)) if i % 9 == 0 else "")) for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 9 <> 0 as int) as quality")
    p = q.Params()
    assert q.labelled_sample(docs, labels, p).count() == 6000
    f = q.fit(docs, labels, p)
    counts, quality = q.text_counts(pa.array([t for _, t in texts])), np.array([i % 9 != 0 for i, _ in texts]).astype(int)
    passed = ~q.base_failed(counts, p)
    again = q.calibrate(q.Forest(f.feature, f.value, f.path, f.depth, f.scale, np.inf), q.features(counts[passed]), quality[passed], p)
    assert f.limit == again.limit
    b = q.fit(docs.repartition(7), labels.repartition(3), p)
    assert b.limit == f.limit and np.array_equal(b.value, f.value)

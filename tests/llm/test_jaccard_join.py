import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from corpuswright.llm import jaccard_join as j
from corpuswright.llm.components import components

from .twins import PAIRS


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(nodes, links):
    up = {v: v for v in nodes}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def plain_kept(rows):
    """Ids that stay: of each component the smallest; all without an id or a word."""
    by_root = defaultdict(list)
    for (d, n, c), root in plain(rows, with_roots=True):
        by_root[root if n and d is not None else object()].append(d)
    return sorted((min(x) if None not in x else None for x in by_root.values()), key=str)


def plain(rows, k=5, percent=75, with_roots=False):
    sets = [shingles(t, k) for _, t in rows]
    where, pairs = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                where[x].append(i)
    for x in where.values():
        pairs.update(combinations(x, 2))
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    # components of rows, named by their smallest doc_id
    root = roots(range(len(rows)), links)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], 1 << 62 if d is None else d)
    named = [(d, len(sets[i]), None if d is None else least[root[i]]) for i, (d, _) in enumerate(rows)]
    return [(r, root[i]) for i, r in enumerate(named)] if with_roots else sorted(named, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = plain(rows)
    assert len({r[2] for r in want}) < len(want)
    assert result(j.op1_jaccard_join(spark, f"/root/testdata/{sf}")) == want


def family(r, words, n, edits, copies):
    base = [r.choice(words) for _ in range(n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(n)] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_near_copies_passages_and_odd_rows(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n, edits, copies in ((60, 2, 60), (40, 1, 30), (25, 1, 30), (12, 1, 20), (7, 1, 20), (200, 8, 40)):
        texts += family(r, words, n, edits, copies)
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(r.randrange(5, 60))) for _ in range(60)]
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d", "A\tb c  d", "a b c d e"] + ["same text again and again"] * 30 + ["Long " * 3000, "x " * 9]
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (3, texts[3]), (3, "other words here that link with nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as set_id", "'x' as n").repartition(5)
    want = plain(rows)
    assert result(j.cluster(docs)) == want
    # hot runs are salted from few rows on; a sketch of few cells and other choices change nothing
    for p in (j.Params(hot_run=4, bloom_bits=64), j.Params(sketch_width=64, spread=0), j.Params(spread=30, hot_run=1)):
        assert result(j.cluster(docs, p)) == want
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == plain_kept(rows)
    assert result(j.cluster(docs.limit(0))) == []
    assert j.keep_one(docs.limit(0)).count() == 0


def test_other_thresholds(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = list(enumerate(t for n in (6, 9, 15, 30) for t in family(r, words, n, 3, 15)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((2, 50), (3, 100)):
        assert result(j.cluster(docs, j.Params(k=k, percent=percent))) == plain(rows, k, percent)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    nodes = {v for a, b in links if a != b for v in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(nodes, links)


def test_crowded_sketch_keeps_no_postings_of_one_class(spark):
    """Where a cell's mean passes the hot run, shingles of one class are still dropped and hardly any is salted."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(400)] + family(r, words, 80, 3, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    p = j.Params(sketch_width=64, hot_run=16)
    sketch = j.read_sketch(j.survey(docs, p), p)
    assert sketch.mean() > 10 * p.hot_run
    kept = j.shared_postings(j.postings(docs, spark.sparkContext.broadcast(sketch), 16, p)).where("shingle IS NOT NULL")
    runs = kept.groupBy("shingle").agg({"set_id": "count"}).toDF("shingle", "n")
    assert 500 < kept.count() < 4000 and runs.where("n = 1").count() == 0
    assert kept.where("salt > 0").count() == 0
    assert result(j.cluster(docs, p)) == plain(list(enumerate(texts)))


def test_texts_with_equal_sums_of_powers_do_not_link(spark):
    rows = list(enumerate(x for pair in PAIRS for x in pair))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(j.cluster(docs)) == plain(rows) and j.keep_one(docs).count() == len(rows)

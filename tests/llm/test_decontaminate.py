import hashlib
import random
import re

from corpuswright.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and n:
            for j in range(len(w) - n + 1):
                grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                got = grams.get(tuple(w[j : j + n]))
                if got:
                    own |= got
                    hit.update(range(j, j + n))
        sha = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id" if "doc_id" in df.columns else "__own_doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain(docs, items)
    assert any(r[5] for r in want)
    assert result(d.op5_decontaminate(spark, sf_dir)) == want


A = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, A), (2, A), (10, "short one É"), (None, "no id here"), (3, None), (4, "..."), (5, "x " * 30), (6, " ".join(f"w{i}" for i in range(12)))]
TEXTS = [None, "", "!", A, f"pad {A.upper()}, pad", "w1 " * 40, "x " * 12, "x, " * 13, "so Short, one-É it is", "no id here", " ".join(f"w{i}" for i in range(3, 15)), " ".join(f"w{i}" for i in range(3, 16)), "y " * 300 + A + " z" * 300, "short one " * 3, "q" * 100_000 + " " + "w7 " * 60_000 + A]


def test_odd_rows(spark):
    rows = [*enumerate(TEXTS), (None, A), (3, A), (3, A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "'q' as hits", "2 as n_words")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'g' as gram")
    for most_bits in (d.FILTER_BITS, 64):  # a filter that is too small lets more through, with equal results
        assert result(d.judge(d.scan(docs, items, most_bits=most_bits))) == plain(rows, ITEMS)
    assert result(d.judge(d.scan(docs, items, window=4, anchor=2))) == plain(rows, ITEMS, 4)
    assert result(d.judge(d.scan(docs, items.limit(0)))) == plain(rows, [])
    assert d.judge(d.scan(docs.limit(0), items)).count() == 0
    kept = d.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in plain(rows, ITEMS) if not r[5])
    spans = {r.doc_id: r.text for r in d.remove_spans(docs.where("doc_id <> 3"), items).collect()}
    assert spans[0] is None and spans[2] == "!" and spans[5] == TEXTS[5]
    assert re.sub(" +", " ", spans[4]) == "pad , pad" and spans[8] == "so , - it is"


def test_many_windows(spark):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((9, 60, 200))))) for i in range(800)]
    texts = []
    for i in range(300):
        w = r.choices(vocabulary, k=r.randrange(20, 300))
        if i % 3 == 0:
            own = items[r.randrange(len(items))][1].split(" ")
            at = r.randrange(max(1, len(own) - 13))
            w[5:5] = own[at : at + r.randrange(12, 40)]
        texts.append((i, " ".join(w)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.item_windows(bench).count() > 60_000
    want = plain(texts, items)
    assert 20 < sum(r[5] for r in want) < 200
    judged = d.judge(d.scan(docs, bench))
    assert result(judged) == want
    plan = judged._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

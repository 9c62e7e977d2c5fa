import random
import re

import public_tokenizers
import pyarrow as pa

from corpuswright.llm import textkit as tk
from corpuswright.llm import token_counts as t

from .twins import PAIRS

PATH = public_tokenizers.path("piece_bpe_32k.model")


def alone(model, word):
    """Forward scores of one word, without any sharing."""
    best, tokens = [0.0], [0]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1] + model.unknown, 1, tokens[end - 1] + len(word[end - 1].encode()))]
        options += [(best[s] + model.pieces[word[s:end]], s - end, tokens[s] + 1) for s in range(end) if word[s:end] in model.pieces]
        top = max(o[0] for o in options)
        # the fallback wins ties, then the shortest last piece
        _, _, n = max((o for o in options if o[0] == top), key=lambda o: o[1])
        best.append(top)
        tokens.append(n)
    return tokens[-1]


def plain(model, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words), sum(alone(model, t.MARK + w) for w in words)


def test_query_equals_plain_scores(spark, sf_dir):
    model = t.load(PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    known = {}  # every distinct word by itself

    def tokens(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for w in words:
            if w not in known:
                known[w] = alone(model, t.MARK + w)
        return len(words), sum(known[w] for w in words)

    want = sorted((i, *tokens(x)) for i, x in rows)
    assert sorted(tuple(r) for r in t.op4_token_counts(spark, sf_dir).collect()) == want


def test_small_vocabulary_ties_and_odd_rows(spark):
    r = random.Random(1)
    model = t.Unigram({t.MARK: -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "aba": -5.0, t.MARK + "a": -3.0, "é": -1.5}, cache_words=3)
    texts = ["".join(r.choice("aabé 日\n") for _ in range(r.randrange(30))) for _ in range(200)] + [None, "", "a" * 3000]
    for first, last, buf, offs in tk.blocks(pa.array(texts), 100):
        n, tokens = model.totals(buf, offs)
        assert [(x, y) for x, y in zip(n.tolist(), tokens.tolist())] == [plain(model, x) for x in texts[first:last]]
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, "same"), (3, "same")], "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    assert sorted((str(x.doc_id), x.n_pretokens) for x in t.count(docs, PATH).collect()) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 1)]
    assert t.count(docs.limit(0), PATH).count() == 0


def test_prefixes_are_shared():
    model = t.load(PATH)
    model.steps = 0
    words = sorted(t.MARK + "counter" + x for x in ("", "s", "part", "parts", "act"))
    model.count(words)
    assert model.steps == len(t.MARK + "counter") + len("act") + len("part") + len("s") + len("s")


def test_words_with_equal_sums_of_powers_are_told_apart():
    model, texts = t.load(PATH), [x for pair in PAIRS for x in pair]
    for _, _, buf, offs in tk.blocks(pa.array(texts)):
        assert model.totals(buf, offs)[1].tolist() == [alone(model, t.MARK + x) for x in texts]

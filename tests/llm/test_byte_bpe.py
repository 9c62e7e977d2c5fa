import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from corpuswright.llm import bpe, byte_bpe

from .twins import PAIRS

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def expected(rows):
    enc, out = library(), []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in byte_bpe.op7_byte_bpe(spark, sf_dir).collect()), key=str) == expected(rows)


def test_odd_tables_and_small_chunks(spark):
    texts = [None, "", "a", "word " * 3000, "l'été ça 's 日本 <|endoftext|>  \n\n x", "same", "same", " \u0000 "]
    rows = [(None, "no id"), *enumerate(texts), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'x' as words").repartition(3)
    for size in (1, 100, 1 << 20):
        assert sorted((tuple(r) for r in byte_bpe.digests(docs, PATH, size).collect()), key=str) == expected(rows)
    tokens = byte_bpe.token_ids(docs, PATH)
    enc = library()
    assert sorted((str(r.doc_id), r.ids) for r in tokens.collect()) == sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(bytes(r.text) for r in byte_bpe.decode_ids(tokens, PATH).collect()) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.digests(docs.limit(0), PATH).count() == 0
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_tokens for r in byte_bpe.digests(only_empty, PATH).collect()] == [0, 0]


def test_packed_ranks():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 1000):
        codes = np.array([r.choice([r.randrange(192), r.randrange(192, 14528), r.randrange(14528, 473280), r.randrange(473280, 1 << 31)]) for _ in range(n)], np.int64)
        assert byte_bpe.unpack(byte_bpe.pack(codes), n).tolist() == codes.tolist()
    edge = np.array([191, 192, 14527, 14528, 473279, 473280, (1 << 31) - 1])
    assert byte_bpe.unpack(byte_bpe.pack(edge), len(edge)).tolist() == edge.tolist()


def test_words_with_equal_sums_of_powers_are_told_apart(spark):
    rows = list(enumerate([x for pair in PAIRS for x in pair] + [" ".join(pair) for pair in PAIRS]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in byte_bpe.digests(docs, PATH).collect()), key=str) == expected(rows)

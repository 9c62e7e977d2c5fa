import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from corpuswright.llm import bpe, scratch, token_files

from .twins import PAIRS

JSON = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(tuple(r) for r in token_files.op10_token_files(spark, sf_dir).collect())
    assert got == expected(rows)


def test_odd_tables_and_small_sequences(spark):
    texts = [None, "", "a", "word " * 3000, "l'été ça 's 日本 <|endoftext|>  \n\n x", "same", "same"]
    rows = [(None, "no id"), *((i, t) for i, t in enumerate(texts)), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as file").repartition(3)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    folder = scratch.new_folder(spark, "t")
    manifest = token_files.write(docs, JSON, folder, sequence_length=7, batch_sequences=2)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in token_files.read(spark, folder, manifest).collect()), key=key) == expected(rows)
    fs, inner = pafs.FileSystem.from_uri(folder)
    with pa.memory_map(f"{inner}/{manifest.first().file}.arrow") as f:
        source = pa.ipc.open_file(f)
        assert source.schema.field("input_ids").type == pa.list_(pa.uint16(), 7)
        one = source.get_batch(0).column("input_ids")[1].values
        assert len(one) == 7
    none = token_files.write(docs.limit(0), JSON, scratch.new_folder(spark, "t"))
    assert token_files.read(spark, folder, none).count() == 0


def test_ranks_of_both_files_are_equal():
    assert bpe.load_ranks(JSON) == bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with pytest.raises((ValueError, KeyError)):
        bpe.load_ranks(public_tokenizers.path("word_bpe_49k.json"))


def test_cache_is_only_a_cache():
    texts = pa.array(["one two three", "two three four", None, "one"])
    from corpuswright.llm import textkit as tk

    big, small = bpe.Encoder(JSON), bpe.Encoder(JSON, 1)
    for _, _, buf, offs in tk.blocks(texts, 10):
        assert [x.tolist() for x in big.encode(buf, offs)] == [x.tolist() for x in small.encode(buf, offs)]


def test_added_tokens_are_the_library_s_at_its_defaults(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [None, "", "a <|endoftext|> b", end, end * 3, f"x{end}{end}y  {end}  z\n", f"don{end}'t", f"日本{end}é ", "<|endof", "text|>", f"<|endof{end}text|>", "plain words", end[:-1]]
    assert len(set(texts)) == len(texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, want, at = Tokenizer.from_file(JSON), [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.op10_token_files(spark, str(tmp_path)).collect()) == want


def test_words_with_equal_sums_of_powers_are_told_apart(spark, tmp_path):
    rows = list(enumerate(x for pair in PAIRS for x in (*pair, " ".join(pair))))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in token_files.op10_token_files(spark, str(tmp_path)).collect()) == expected(rows)


def test_one_id_on_many_rows_is_spread(spark):
    rows = [(7, f"text number {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert max(len(x) for x in token_files.ranged(docs).select("doc_id").rdd.glom().collect()) < 200
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    folder = scratch.new_folder(spark, "t")
    assert sorted((tuple(r) for r in token_files.read(spark, folder, token_files.write(docs, JSON, folder)).collect()), key=lambda r: r[1]) == expected(rows)

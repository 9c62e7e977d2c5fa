"""From raw documents to token digests in five stages, each a table of its own.

Quality rules and the quality classifier drop bad documents, the n-gram Jaccard join leaves one
document of each group of near copies, decontamination drops what holds benchmark passages, and
byte-level BPE encodes what is left (and decodes it again). Every stage works on all rows that the
one before kept and, but for the last, returns them with the columns of ``documents``.

Defined results: null and empty texts fail the rules; null ids stay, as long as their text passes; of rows with equal texts one stays,
that with the smallest id; an id with several texts keeps all that pass; without labelled rows nothing is
rejected but by the fixed rules; an empty table gives an empty one. Further columns of any name go through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuswright.llm import byte_bpe, decontaminate, jaccard_join, quality_knn, quality_rules, scratch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.stage(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.stage(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, VOCABULARY)


STAGES = [
    ("quality rules", _rules),
    ("quality classifier", _classifier),
    ("n-gram Jaccard join", _near_copies),
    ("benchmark decontamination", _benchmark),
    ("byte-level BPE", _encode),
]
#: The forest, the classifier and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        since = scratch.mark()
        made = stage(spark, docs, sf_dir)
        path = f"{scratch.shared_root(spark)}/pipeline/{scratch.fresh_name(name)}"
        made.write.parquet(path)
        scratch.release(spark, since)
        if before:  # only the last stage's input is still needed
            scratch.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Training examples as token ids: prompt and answer apart, the prompt masked, long ones dropped, masks audited."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from . import batching


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str):  # noqa: ANN201
    """A pandas UDF from text to ids by a tokenizers file, without special tokens; whole batches at once."""

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in _tokenizer(path).encode_batch(text.fillna("").tolist(), add_special_tokens=False)])

    return encode


def decoder(path: str):  # noqa: ANN201
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([_tokenizer(path).decode(list(map(int, x)), skip_special_tokens=False) for x in ids])

    return decode


def prompt_and_answer(rows: DataFrame, system: str) -> DataFrame:
    """Adds ``prompt`` and ``answer`` to rows with ``messages``; ones that don't end with a question and its answer raise."""
    m = F.col("messages")
    paired = F.coalesce((F.try_element_at(m, F.lit(-1))["role"] == "assistant") & (F.try_element_at(m, F.lit(-2))["role"] == "user"), F.lit(False))
    before = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))))
    fault = F.raise_error(F.concat(F.lit("rows must end with a user and assistant pair: "), F.col("id"))).cast("string")
    return rows.withColumn("prompt", F.when(paired, prompts.render_prompt(before)).otherwise(fault)).withColumn("answer", F.trim(F.try_element_at(m, F.lit(-1))["content"]))


def examples(rows: DataFrame, system: str, path: str, most: int | None = None) -> DataFrame:
    """(id, split, answer, input_ids, labels): the prompt's ids and the answer's, encoded apart; only the answer's are learned."""
    encode = encoder(path)
    cut = prompt_and_answer(rows, system)
    ids = cut.select("id", "split", "answer", encode("prompt").alias("p"), encode(prompts.completion_text(F.col("answer"))).alias("a"))
    out = ids.select("id", "split", "answer", F.concat("p", "a").alias("input_ids"), batching.mask_prompt(F.col("p"), F.col("a")).alias("labels"))
    return out if most is None else batching.fitting(out, "input_ids", most)


def learned(labels: Column, ignored: int = -100) -> Column:
    return F.filter(labels, lambda x: x != ignored)


def mask_faults(made: DataFrame, path: str) -> DataFrame:
    """(id, fault) of examples whose learned ids aren't exactly the answer and the end mark, or don't end the example."""
    decode = decoder(path)
    told = made.select("id", "answer", learned(F.col("labels")).alias("own"), "input_ids").withColumn("text", decode("own"))
    tail = F.slice("input_ids", F.size("input_ids") - F.size("own") + 1, F.size("own"))
    fault = F.when(F.col("text") != prompts.completion_text(F.col("answer")), "the mask does not cover the answer").when(tail != F.col("own"), "the answer does not end the example")
    return told.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def report(made: DataFrame) -> DataFrame:
    """By split: rows, tokens, learned tokens, mean, middle, 99th percentile and longest, by rank."""
    sized = made.select("split", F.size("input_ids").alias("n"), F.size(learned(F.col("labels"))).alias("a"))
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)")
    return sized.groupBy("split").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.sum("a").alias("supervised"), F.round(F.avg("n"), 1).alias("mean"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.max("n").alias("longest"), F.max("a").alias("longest_answer"))

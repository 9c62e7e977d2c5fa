"""The driver's tables as the engine's inputs: cards, query sets, entities and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: the title is what stands before the first full stop."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("card_id"), F.substring_index("text", ".", 1).alias("title"), "source", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CARDS_SQL = "cards AS (SELECT doc_id AS card_id, split_part(text, '.', 1) AS title, source, text FROM documents)"

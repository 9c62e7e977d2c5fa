"""The registered queries of this subpackage and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_knn, quality_rules, resample, sessions, shards, token_counts, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_warc": warc.op2_warc,
    "op3_sharding": shards.op3_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": quality_knn.op9_quality_classifier,
    "op10_token_files": token_files.op10_token_files,
    "op11_resample": resample.op11_resample,
    "op12_sessionise": sessions.op12_sessionise,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_sharding": shards.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op11_resample": resample.OP11_SQL,
    "op12_sessionise": sessions.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}

"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchglass.llm import bpe, chat, compression, line_dedup, packing, quality_rules, simhash, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": compression.query,
    "op10_backtracking_bpe": bpe.query,
    "op2_best_fit_packing": packing.query,
    "op3_toxicity_network": toxicity.query,
    "op4_uniform_threshold_topk": topk.query,
    "op5_line_dedup": line_dedup.query,
    "op6_chat_roles": chat.query,
    "op7_simhash_golay": simhash.query,
    "op8_url_filter": url_filter.query,
    "op9_decision_list": quality_rules.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_uniform_threshold_topk": topk.SQL,
    "op8_url_filter": url_filter.SQL,
}

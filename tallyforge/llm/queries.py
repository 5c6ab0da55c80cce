"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversations, exact_dedup, language_id, language_model, line_dedup, near_dedup, packing, passage_graph, quality, resampling, suffix_dedup, vector_search

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_vector_search": vector_search.op1_vector_search,
        "op2_packing": packing.op2_packing,
        "op3_language_id": language_id.op3_language_id,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_quality": quality.op5_quality,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_language_model": language_model.op7_language_model,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_ngram_join": near_dedup.op9_ngram_join,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_passage_graph": passage_graph.op12_passage_graph,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": line_dedup.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op12_passage_graph": passage_graph.ORACLE,
    }

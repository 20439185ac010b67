"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyledger.llm import bpe, byte_bpe, chat, decontamination, extraction, langid, lm_scoring, near_duplicates, oracles, quality, search, suffix_dedup, warc, whitening

_QUERIES = (
    lm_scoring.op1_lm_scoring,
    decontamination.op2_benchmark_decontamination,
    near_duplicates.op3_jaccard_join,
    langid.op4_language_id,
    bpe.op5_bpe,
    suffix_dedup.op6_suffix_dedup,
    extraction.op7_html_extraction,
    quality.op8_quality_rules,
    warc.op9_warc,
    chat.op10_chat_formatting,
    search.op11_lexical_search,
    whitening.op12_embedding_whitening,
    byte_bpe.op13_byte_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

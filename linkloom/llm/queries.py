"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontam, html_text, jaccard, langid, mixing, phrases, quality, secret_scan, substring, toxicity, urls, vector_code, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_embedding_dedup": vectors.op4_embedding_dedup,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_url_filter": urls.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html_text": html_text.op8_html_text,
    "op9_language_id": langid.op9_language_id,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_quality_rules": quality.op11_quality_rules,
    "op12_vector_code": vector_code.op12_vector_code,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op4_embedding_dedup": vectors.OP4_SQL,
    "op6_url_filter": urls.OP6_SQL,
    "op12_vector_code": vector_code.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}

"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karvan.llm import q_dedup, q_mixing, q_phrases, q_records, q_scoring, q_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": q_scoring.op1_toxicity,
    "op2_url_filter": q_scoring.op2_url_filter,
    "op3_substring_dedup": q_dedup.op3_substring_dedup,
    "op4_sentencepiece": q_scoring.op4_sentencepiece,
    "op5_mixing": q_mixing.op5_mixing,
    "op6_topk": q_vectors.op6_topk,
    "op7_quality": q_scoring.op7_quality,
    "op8_near_dedup": q_dedup.op8_near_dedup,
    "op9_embedding_dedup": q_vectors.op9_embedding_dedup,
    "op10_html_text": q_scoring.op10_html_text,
    "op11_warc": q_records.op11_warc,
    "op12_collocations": q_phrases.op12_collocations,
    "op13_merkle_manifest": q_records.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op5_mixing": q_mixing.SQL,
    "op6_topk": q_vectors.TOPK_SQL,
    "op11_warc": q_records.WARC_SQL,
    "op12_collocations": q_phrases.SQL,
    "op13_merkle_manifest": q_records.MERKLE_SQL,
}

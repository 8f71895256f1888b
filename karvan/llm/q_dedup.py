"""Queries: repeats, near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm.common import read
from karvan.llm.near_dedup import near_duplicates
from karvan.llm.substring_dedup import repeated_spans


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a window of an earlier document, cut out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document; ``kept`` marks the one that stays."""
    classes = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))

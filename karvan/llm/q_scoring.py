"""Queries: classifiers over documents and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm.common import held_out, read
from karvan.llm.html_text import extract_pages
from karvan.llm.pieces import encode_texts
from karvan.llm.quality import score_quality
from karvan.llm.quality import train as train_quality
from karvan.llm.toxicity import score_toxicity
from karvan.llm.toxicity import train as train_toxicity
from karvan.llm.url_filter import judge_urls


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url: the longest rule that fits, else the learned judge."""
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as piece ids: its three best segmentations with their scores."""
    return encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

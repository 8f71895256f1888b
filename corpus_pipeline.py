"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next one reads what it
wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm import mixing, near_dedup, pieces, substring_dedup, toxicity
from karvan.llm.common import read, written

#: Rows of an Arrow batch. Texts are long: ten thousand of them, the default, take a worker more
#: memory than the work on them.
BATCH_ROWS = 1_000

#: SQL has no counterpart of the learned and sampled stages; tests compare them with brute force.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier calls toxic go; it learns from the labels that are not held out."""
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, "_toxic").where(F.col("_toxic") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays: the one with the smallest id."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are cut out of the texts."""
    small_batches(spark)
    return substring_dedup.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the default weights: a row per reading of a document, in training order."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every reading."""
    small_batches(spark)
    return pieces.encode_texts(docs, ["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries: searches and classes over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm.common import read
from karvan.llm.embedding_dedup import embedding_classes
from karvan.llm.topk import top_products, usable_integers


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embedding_classes(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer products of every 20th vector with all others."""
    vectors = usable_integers(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_products(vectors, F.col("vec_id") % 20 == 0, 20)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

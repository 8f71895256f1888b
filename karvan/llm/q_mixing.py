"""Query: the whole corpus mixed to the default weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm.common import read, word_count, written
from karvan.llm.mixing import in_order, plan_mix


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read in the mix, and where in training it first appears."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = plan_mix(written(docs, "mix-sizes"))
    return in_order(plan).select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("first_position", 9).alias("first_position"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r, sum(source_size) OVER () AS total FROM sums),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(r % 3 + 1 AS INT)] AS DOUBLE) AS w, [-0.5, 0.0, 0.5][CAST(r % 3 + 1 AS INT)]::DOUBLE AS slope,
         source_size * 3.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS fills,
    (CAST(total AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, slope,
    least(cap, coalesce((SELECT arg_min(level, (fills, r)) FROM levels WHERE fills >= level), 0) * w) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS off
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passed AS (
  SELECT *, CAST(whole + CASE WHEN target - whole * source_size > 0 AND off + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS passes,
    least(1.0::DOUBLE, off / target) AS y FROM placed)
SELECT doc_id, size, source_size, target, passes * size AS taken, passes,
  CASE WHEN passes > 0 THEN round(CASE WHEN slope = 0 THEN y
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END, 9) END AS first_position
FROM passed
"""

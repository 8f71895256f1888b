"""Query: collocations of every language, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from karvan.llm.collocations import collocations
from karvan.llm.common import read


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of every language whose words keep together most."""
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM places),
phrases AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM grams WHERE i + k - 1 <= len(w))
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, l.a AS l, r.a AS r, s.n, (1000::HUGEINT * c.a * s.n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN sizes s ON c.lang = s.lang
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.c], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1 : c.k], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_starts AS (SELECT lang, a, w, k, unnest(range(1, k)) AS i FROM candidates),
inner_parts AS (SELECT lang, a, k, i, w, unnest(range(2, k)) AS m FROM inner_starts),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_parts WHERE i + m - 1 <= k GROUP BY 1, 2),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

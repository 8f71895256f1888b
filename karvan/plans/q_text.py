"""Scalar function queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.functions import text as tx
from karvan.functions import titles
from karvan.plans import views as v
from karvan.plans.registry import query

WS = r"[\t-\r\x1c-\x20\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '«»“”‘’‐‑‒–—―−',
      repeat(chr(34), 4) || repeat(chr(39), 2) || '-------'),
    '[\x{064b}-\x{0655}\x{0670}]', '', 'g'), '[\p{So}\p{Sk}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]', '', 'g'),
    '[\x{200b}\x{200d}\x{feff}]', '', 'g'), '@WS@', ' ', 'g'))"""
DOC = NORMAL.replace("@WS@", WS)


def docs(spark, d):
    return v.spread(v.table(spark, d, "documents").select("doc_id", "text"))


@query("normalize_text", "", f"SELECT doc_id, sha256({DOC}) AS h FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.normalize_text(F.col("text")), 256).alias("h"))


@query(
    "normalize_part_number",
    "",
    f"SELECT doc_id, sha256(regexp_replace(upper(replace({DOC}, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')) AS h FROM documents",
)
def normalize_part_number(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.normalize_part_number(F.col("text")), 256).alias("h"))


@query(
    "looks_like_part_number",
    "",
    """
  SELECT c_custkey, regexp_matches(c, '^[A-Za-z0-9\\s._/+\\-#]+$') AND regexp_matches(r, '^[A-Z0-9]{5,20}$') AND regexp_matches(r, '[0-9]') AS is_code
  FROM (SELECT c_custkey, c, regexp_replace(upper(c), '[^A-Z0-9]', '', 'g') AS r FROM (
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN c_name || ', no' ELSE 'A-' || c_custkey END AS c FROM customer))""",
)
def looks_like_part_number(spark, d):
    k = F.col("c_custkey")
    c = (
        F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.col("c_mktsegment"))
        .when(k % 4 == 2, F.concat("c_name", F.lit(", no"))).otherwise(F.concat(F.lit("A-"), k))
    )
    return v.table(spark, d, "customer").select("c_custkey", tx.looks_like_part_number(c).alias("is_code"))


FOLD_DOC = f"trim(regexp_replace(lower({DOC}), '[^0-9a-zA-Z\\x{{0600}}-\\x{{06ff}}]+', ' ', 'g'))"


@query("match_fold", "", f"SELECT doc_id, sha256({FOLD_DOC}) AS h FROM documents")
def match_fold(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.match_fold(F.col("text")), 256).alias("h"))


@query("strip_promotional")
def strip_promotional(spark, d):
    """No oracle: the patterns look behind, which RE2 cannot. Golden tests instead."""
    return docs(spark, d).select("doc_id", F.sha2(titles.strip_promotional(F.col("text")), 256).alias("h"))


@query("contains_promotional")
def contains_promotional(spark, d):
    return docs(spark, d).select("doc_id", titles.contains_promotional(F.col("text")).alias("promotional"))


@query(
    "is_sane_title",
    "",
    f"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^{WS}', ''), '{WS}$', '')) BETWEEN 12 AND 500 AS sane FROM documents",
)
def is_sane_title(spark, d):
    return docs(spark, d).select("doc_id", titles.is_sane_title(F.col("text"), 12, 500).alias("sane"))


@query("strip_phones_prices")
def strip_phones_prices(spark, d):
    """No oracle: look-behind again. Golden tests instead."""
    return docs(spark, d).select("doc_id", F.sha2(tx.strip_phones_prices(F.col("text")), 256).alias("h"))


@query(
    "tokenize",
    "",
    """
  SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id,
    list_filter(string_split(regexp_replace(text, '[^0-9A-Za-z\\x{0600}-\\x{06ff}\\-./_+]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents)""",
)
def tokenize(spark, d):
    t = tx.tokenize(F.col("text"))
    return docs(spark, d).select(
        "doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h")
    )


@query("content_tokens")
def content_tokens(spark, d):
    t = tx.content_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


@query(
    "slugify",
    "",
    """
  WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9ء-غف-يپچژکگی]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents),
  c AS (SELECT doc_id, CASE WHEN length(s) > 80 THEN regexp_replace(regexp_replace(substr(s, 1, 80), '-[^-]*$', ''), '^-+|-+$', '', 'g') ELSE s END AS s FROM b)
  SELECT doc_id, CASE WHEN s = '' THEN '' ELSE s || '-' END || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 6) AS slug FROM c""",
)
def slugify(spark, d):
    slug = titles.build_slug(F.col("text"), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", slug.alias("slug"))


@query(
    "utc_iso",
    "",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS iso FROM events",
)
def utc_iso(spark, d):
    return v.table(spark, d, "events").select("event_id", tx.utc_iso(F.col("ts").cast("timestamp")).alias("iso"))


@query(
    "urljoin_host",
    "",
    """
  WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o, regexp_extract(url, '^https?://[^/?#]*(/(?:[^?#]*/)?)', 1) AS f FROM pages)
  SELECT page_id, 'abs' AS kind, 'https://x.example/a' AS joined FROM p
  UNION ALL SELECT page_id, 'root', o || '/img/1.png' FROM p
  UNION ALL SELECT page_id, 'rel', o || CASE WHEN f = '' THEN '/' ELSE f END || 'b.html' FROM p
  UNION ALL SELECT page_id, 'query', regexp_replace(u, '\\?.*$', '') || '?q=1' FROM p""",
)
def urljoin_host(spark, d):
    links = F.create_map(
        F.lit("abs"), F.lit("https://x.example/a"), F.lit("root"), F.lit("/img/1.png"),
        F.lit("rel"), F.lit("./b.html"), F.lit("query"), F.lit("?q=1"),
    )
    pages = v.table(spark, d, "pages").select("page_id", "url", F.explode(links).alias("kind", "link"))
    return pages.select("page_id", "kind", tx.urljoin(F.col("url"), F.col("link")).alias("joined"))

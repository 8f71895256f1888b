"""Queries: archives of the pages, the manifest of the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.llm.common import delete_at_end, read, shared_path, written
from karvan.llm.merkle import FIELDS, leaf_hash, manifest, verify
from karvan.llm.warc import assemble, field, read_archives, salts_for, with_originals, write_archives

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archived transaction, read back: what was stored and what it refers to."""
    path = shared_path(spark, "warc-archives")
    n = write_archives(read(spark, sf_dir, "pages"), path)
    delete_at_end(spark, path)
    # Digests and sizes of payloads were taken on reading; only metadata payloads are needed below.
    slim = F.when(F.col("type") == "metadata", F.col("payload"))
    records = written(read_archives(spark, path).withColumn("payload", slim), "warc-records")
    rows = assemble(records).withColumn("page_id", field(F.col("metadata.payload"), "page-id").cast("long"))
    rows = written(rows.select("record_id", "type", "refers_to", "page_id", "payload_bytes", "payload_sha1"), "warc-rows")
    whole = with_originals(rows, ["page_id", "payload_bytes", "payload_sha1"], salts_for(n))
    revisit = F.col("type") == "revisit"
    return whole.select(
        "page_id",
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_sha1")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, F.col("original.page_id")).alias("refers_to"),
    )


WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
judged AS (
  SELECT *, strlen(h) >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM payloads)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM judged
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, checked against rows of which a third were tampered with."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    changed = chosen & F.col("text").rlike("[A-Z]")
    whole = leaf_hash([F.col(c) for c in FIELDS])
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        whole.alias("digest"),
        F.when(changed, leaf_hash([tampered if c == "text" else F.col(c) for c in FIELDS])).alias("claimed"),
    )
    proofs = manifest(written(leaves, "merkle-hashes"), ["doc_id"])
    checked = verify(proofs.withColumn("claimed", F.coalesce("claimed", "digest")), "claimed")

    def digest(name: str, alias: str):
        return F.lower(F.hex(name)).alias(alias)

    return checked.select(
        "doc_id",
        digest("digest", "leaf"),
        digest("subroot", "subroot"),
        digest("root", "root"),
        digest("proof", "proof_sha256"),
        digest("folded", "folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_PARTS = [_FIELD.format(f"CAST({c} AS VARCHAR)") for c in FIELDS[:-1]]
_LEAF = "sha256({0})".format(" || ".join([*_PARTS, _FIELD.format("text")]))
_CLAIMED = "sha256({0})".format(" || ".join([*_PARTS, _FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')")]))
#: One tree per step: nodes of all levels, then every leaf's siblings and the fold along them.
MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
    CASE WHEN list_reduce(
      flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT) % 3 = 0
    THEN {_CLAIMED} ELSE {_LEAF} END AS claimed
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, size, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, any_value(size + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY lang, level, pos // 8),
subroots AS MATERIALIZED (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, size, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, any_value(size + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY level, pos // 8),
every AS MATERIALIZED (
  SELECT FALSE AS top, lang, level, pos, size, digest FROM nodes WHERE size > 1
  UNION ALL SELECT TRUE, NULL, level, pos, size, digest FROM tops WHERE size > 1),
runs AS MATERIALIZED (
  SELECT a.top, a.lang, a.level, a.pos, a.size,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before_it,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after_it
  FROM every a JOIN every b ON a.top = b.top AND a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8
  GROUP BY a.top, a.lang, a.level, a.pos, a.size),
steps AS (
  SELECT row_number() OVER () AS id, l.doc_id, l.lang, l.leaf, FALSE AS top, 0 AS level, l.pos, l.size, l.claimed AS digest, '' AS proof, s.digest AS subroot, s.pos AS top_pos, s.size AS top_size
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT s.id, s.doc_id, s.lang, s.leaf,
    CASE WHEN s.size > 1 THEN s.top ELSE TRUE END,
    CASE WHEN s.size > 1 THEN s.level + 1 ELSE 0 END,
    CASE WHEN s.size > 1 THEN s.pos // 8 ELSE s.top_pos END,
    CASE WHEN s.size > 1 THEN (s.size + 7) // 8 ELSE s.top_size END,
    CASE WHEN s.size > 1 THEN sha256(r.before_it || s.digest || r.after_it) ELSE s.digest END,
    CASE WHEN s.size > 1 THEN s.proof || r.before_it || r.after_it ELSE s.proof END, s.subroot, s.top_pos, s.top_size
  FROM steps s LEFT JOIN runs r ON s.size > 1 AND s.top = r.top AND r.lang IS NOT DISTINCT FROM (CASE WHEN s.top THEN NULL ELSE s.lang END) AND s.level = r.level AND s.pos = r.pos
  WHERE s.size > 1 OR NOT s.top)
SELECT f.doc_id, f.leaf, f.subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM steps f, (SELECT digest FROM tops WHERE size = 1) t WHERE f.top AND f.size = 1
"""

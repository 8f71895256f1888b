"""Change capture queries over the offer events."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.functions import ids
from karvan.operators import cdc
from karvan.plans import views as v
from karvan.plans.registry import query


def _secs(name: str):
    return F.unix_timestamp(F.col(name).cast("timestamp")).alias(name)


@query(
    "exact_dedupe",
    "price_events",
    """
  SELECT event_id, min(price_toman) AS price_toman FROM (
    SELECT event_id, price_toman FROM price_events
    UNION ALL SELECT event_id, price_toman FROM price_events WHERE line_no = 1) GROUP BY event_id""",
)
def exact_dedupe(spark, d):
    ev = v.price_events(spark, d).select(
        F.lit("offers").alias("topic"), "event_id", "price_toman", "line_no"
    )
    redelivered = ev.unionByName(ev.where("line_no = 1"))
    return cdc.exact_dedupe(redelivered).select("event_id", "price_toman")


@query(
    "latest_state",
    "offers",
    """
  SELECT offer_uid, event_id, CAST(epoch(occurred_at) AS BIGINT) AS occurred_at, price_toman,
    stock_status, title_normalized FROM offers""",
)
def latest_state(spark, d):
    return v.offers(spark, d).select(
        "offer_uid", "event_id", _secs("occurred_at"), "price_toman", "stock_status",
        "title_normalized",
    )


@query(
    "compact_with_tombstones",
    "price_state",
    """
  SELECT offer_uid, CASE WHEN line_no <> 7 THEN stock_status END AS payload, line_no = 7 AS is_deleted
  FROM price_state""",
)
def compact_with_tombstones(spark, d):
    ev = v.price_events(spark, d).select(
        "offer_uid", "event_id", "occurred_at",
        F.when(F.col("line_no") != 7, F.col("stock_status")).alias("payload"),
    )
    out = cdc.compact_with_tombstones(ev, ["offer_uid"], "payload")
    return out.select("offer_uid", "payload", "is_deleted")


@query(
    "cdc_fragment",
    "price_events",
    """
  WITH h AS (SELECT *, sha256(coalesce(CAST(price_toman AS VARCHAR), '') || '|' || stock_status) AS fragment_hash FROM price_events),
  m AS (SELECT *, CASE WHEN lag(fragment_hash) OVER w IS DISTINCT FROM fragment_hash THEN 1 ELSE 0 END AS changed
        FROM h WINDOW w AS (PARTITION BY source_key, external_key ORDER BY occurred_at, event_id)),
  i AS (SELECT *, sum(changed) OVER (PARTITION BY source_key, external_key ORDER BY occurred_at, event_id) AS island FROM m)
  SELECT source_key, external_key, fragment_hash, CAST(epoch(min(occurred_at)) AS BIGINT) AS observed_at,
    CAST(epoch(max(occurred_at)) AS BIGINT) AS last_seen_at
  FROM i GROUP BY source_key, external_key, island, fragment_hash""",
)
def cdc_fragment(spark, d):
    ev = v.price_events(spark, d).select(
        "source_key", "external_key", "occurred_at", "event_id",
        F.sha2(F.concat(F.coalesce(F.col("price_toman").cast("string"), F.lit("")), F.lit("|"), "stock_status"), 256)
        .alias("fragment_hash"),
    )
    runs = cdc.cdc_fragment(ev, ["source_key", "external_key"], "fragment_hash", "occurred_at", "event_id")
    return runs.select(
        "source_key", "external_key", "fragment_hash",
        F.unix_timestamp("occurred_at").alias("observed_at"), _secs("last_seen_at"),
    )


@query(
    "fragment_cap",
    "",
    """
  SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN strlen(text)
    ELSE 2000 - CASE WHEN (b[2001] // 64) <> 2 THEN 0 WHEN (b[2000] // 64) <> 2 THEN 1
                     WHEN (b[1999] // 64) <> 2 THEN 2 ELSE 3 END END AS n_bytes,
    starts_with(text, text) AS is_prefix
  FROM (SELECT doc_id, text, list_transform(range(1, 2002), lambda i: CASE WHEN i < 1998 THEN 0 ELSE
      CAST('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER) END) AS b
    FROM documents WHERE strlen(text) > 2000
    UNION ALL SELECT doc_id, text, [] FROM documents WHERE strlen(text) <= 2000)""",
)
def fragment_cap(spark, d):
    docs = v.table(spark, d, "documents")
    cut = cdc.fragment_cap(F.col("text"), 2000)
    return docs.select(
        "doc_id",
        F.octet_length(cut).cast("long").alias("n_bytes"),
        F.startswith(F.col("text"), cut).alias("is_prefix"),
    )


@query(
    "offer_uid",
    "price_events",
    "SELECT DISTINCT source_key, external_key, offer_uid FROM price_events",
)
def offer_uid(spark, d):
    keys = v.price_events(spark, d).select("source_key", "external_key").distinct()
    return keys.withColumn("offer_uid", ids.offer_uid(F.col("source_key"), F.col("external_key")))


@query(
    "material_change",
    "offer_events",
    """
  WITH h AS (SELECT offer_uid, event_id, occurred_at, concat_ws('|', coalesce(brand,'~'), coalesce(part_number,'~'),
      coalesce(part_type,'~'), pack_quantity, authenticity_claim) AS s FROM offer_events)
  SELECT offer_uid, event_id FROM (SELECT *, lag(s) OVER (PARTITION BY offer_uid ORDER BY occurred_at, event_id) AS p FROM h)
  WHERE p IS DISTINCT FROM s""",
)
def material_change(spark, d):
    fields = ["brand", "part_number", "part_type", "pack_quantity", "authenticity_claim"]
    ev = v.offer_events(spark, d).select("offer_uid", "event_id", "occurred_at", *fields)
    return cdc.material_change(ev, ["offer_uid"], fields).select("offer_uid", "event_id")


CHANGE_POINTS = """
  SELECT offer_uid, product_uid, occurred_at AS observed_at, price_toman, stock_status FROM (
    SELECT *, lag(price_toman) OVER w AS p, lag(stock_status) OVER w AS s FROM (
      SELECT * FROM price_events
      QUALIFY row_number() OVER (PARTITION BY offer_uid, occurred_at ORDER BY event_id DESC) = 1)
    WINDOW w AS (PARTITION BY offer_uid ORDER BY occurred_at))
  WHERE s IS NULL OR s <> stock_status OR p IS DISTINCT FROM price_toman"""


@query(
    "price_change_points",
    "price_events",
    f"""SELECT offer_uid, product_uid, CAST(epoch(observed_at) AS BIGINT) AS observed_at, price_toman,
    stock_status FROM ({CHANGE_POINTS})""",
)
def price_change_points(spark, d):
    points = cdc.price_change_points(v.price_events(spark, d))
    return points.select("offer_uid", "product_uid", _secs("observed_at"), "price_toman", "stock_status")


@query(
    "document_hash",
    "price_state",
    """
  WITH new AS (SELECT offer_uid, CAST(epoch(occurred_at) AS BIGINT) AS updated_at, price_toman, stock_status,
     sha256(to_json({price_toman: price_toman, stock_status: stock_status})) AS h FROM price_state),
  old AS (SELECT offer_uid, CAST(epoch(occurred_at) AS BIGINT) AS updated_at,
     sha256(to_json({price_toman: price_toman, stock_status: stock_status})) AS h FROM (
       SELECT * FROM price_events WHERE occurred_at < TIMESTAMP '2000-06-01'
       QUALIFY row_number() OVER (PARTITION BY offer_uid ORDER BY occurred_at DESC, event_id DESC) = 1))
  SELECT new.offer_uid, new.h AS document_hash, new.h IS DISTINCT FROM old.h AS changed,
    CASE WHEN new.h IS DISTINCT FROM old.h THEN new.updated_at ELSE old.updated_at END AS updated_at
  FROM new LEFT JOIN old USING (offer_uid)""",
)
def document_hash(spark, d):
    cols = ["price_toman", "stock_status"]
    ev = v.price_events(spark, d).select("offer_uid", "event_id", "occurred_at", *cols)
    stamp = F.unix_timestamp("occurred_at").alias("updated_at")
    new = cdc.latest_state(ev, ["offer_uid"]).select("offer_uid", *cols, stamp)
    earlier = ev.where(F.col("occurred_at") < F.lit("2000-06-01").cast("timestamp"))
    old = cdc.latest_state(earlier, ["offer_uid"]).select("offer_uid", *cols, stamp)
    old = old.withColumn("document_hash", ids.canonical_hash(cols))
    out = cdc.keep_old_timestamp(new, old, "offer_uid", cols)
    return out.select("offer_uid", "document_hash", "changed", "updated_at")


@query(
    "debounced_emission",
    "",
    """
  WITH RECURSIVE c AS (
    SELECT user_id, event_id, epoch_us(ts) AS us, CAST(floor(value / 20) AS BIGINT) AS content FROM events),
  w AS (
    SELECT user_id, min(us) AS s FROM c GROUP BY user_id
    UNION ALL
    SELECT w.user_id, (SELECT min(us) FROM c WHERE c.user_id = w.user_id AND c.us >= w.s + 21600000000) AS s
    FROM w WHERE w.s IS NOT NULL),
  e AS (
    SELECT w.user_id, w.s, arg_max(content, (us, event_id)) AS content, count(*) AS changes_folded
    FROM w JOIN c ON c.user_id = w.user_id AND c.us >= w.s AND c.us < w.s + 21600000000 GROUP BY w.user_id, w.s)
  SELECT user_id, CAST(s + 21600000000 AS BIGINT) AS emitted_us, content, changes_folded FROM (
    SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY s) AS p FROM e) WHERE p IS DISTINCT FROM content""",
)
def debounced_emission(spark, d):
    """Windows widened to six hours because the event table is sparse per key."""
    ev = v.table(spark, d, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("occurred_at"),
        F.floor(F.col("value") / 20).alias("content"),
    )
    out = cdc.debounced_emission(ev, "user_id", "content", quiet_seconds=21600)
    return out.select(
        "user_id", F.unix_micros("emitted_at").alias("emitted_us"), "content", "changes_folded"
    )


@query(
    "reprocess_stale",
    "offer_events",
    """
  WITH f AS (SELECT offer_uid, CAST(epoch(min(occurred_at)) AS BIGINT) AS first_seen_at,
      arg_max(struct_pack(t := title_normalized, ver := 1 + line_no % 3), (occurred_at, event_id)) AS r
    FROM offer_events GROUP BY offer_uid)
  SELECT offer_uid, upper(r.t) AS title_normalized, first_seen_at, 'v3' AS normalizer_version FROM f WHERE r.ver < 3""",
)
def reprocess_stale(spark, d):
    ev = v.offer_events(spark, d)
    first = F.min("occurred_at").alias("first_seen_at")
    latest = F.max_by(
        F.struct("title_normalized", F.concat(F.lit("v"), F.col("line_no") % 3 + 1).alias("normalizer_version"), "occurred_at"),
        F.struct("occurred_at", "event_id"),
    )
    offers = ev.groupBy("offer_uid").agg(first, latest.alias("r")).select("offer_uid", "first_seen_at", "r.*")
    again = offers.select(
        "offer_uid", F.upper("title_normalized").alias("title_normalized"),
        F.col("occurred_at").alias("first_seen_at"),
    )
    out = cdc.reprocess_stale(offers, again, "v3")
    return out.select("offer_uid", "title_normalized", _secs("first_seen_at"), "normalizer_version")


@query(
    "seller_provision",
    "offer_events",
    """
  SELECT seller_key, seller_key AS name, seller_key || '.example' AS domain, arg_min(source_key, (occurred_at, event_id)) AS source_key,
    CAST(epoch(min(occurred_at)) AS BIGINT) AS first_seen_at FROM offer_events GROUP BY seller_key""",
)
def seller_provision(spark, d):
    out = cdc.seller_provision(v.offer_events(spark, d))
    return out.select("seller_key", "name", "domain", "source_key", _secs("first_seen_at"))

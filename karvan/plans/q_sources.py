"""Source and sink queries. Files are written from the given tables to the shared folder
and read back through the connector under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from karvan import schemas
from karvan.operators import cdc
from karvan.plans import views as v
from karvan.plans.registry import query
from karvan.session import cut_lineage, ensure_checkpoint_dir
from karvan.sources import feeds, html, sinks, topics


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/karvan-{name}-{uuid.uuid4().hex[:12]}"


def offer_messages(spark, d):
    """Enriched-offer messages as JSON: one in 50 is a tombstone, one in 70 garbage."""
    e = v.offer_events(spark, d)
    payload = F.struct(
        "offer_uid", "seller_key", "title_normalized", "brand", "part_number", "part_type", "authenticity_claim",
        F.when(F.col("event_id") >= "f", "sold").otherwise(F.col("stock_status")).alias("stock_status"),
        F.col("pack_quantity").cast("int").alias("pack_quantity"), "price_toman", "vehicle_hints", F.lit(1).alias("field_from_the_future"),
    )
    body = F.struct(
        "event_id", F.lit("offers.enriched").alias("event_type"), F.lit(1).alias("version"), "occurred_at",
        F.when(F.substring("event_id", 1, 2) != "00", payload).alias("payload"),
    )
    text = F.to_json(body)
    return e.select(F.col("offer_uid").alias("key"), F.when(F.substring("event_id", 1, 2) == "01", "not json").otherwise(text).alias("value"))


@query(
    "read_topic",
    "offer_events",
    """
  SELECT CASE WHEN substr(event_id, 1, 2) <> '01' THEN event_id END AS event_id, CASE WHEN substr(event_id, 1, 2) > '01' THEN price_toman END AS price_toman,
    CASE WHEN substr(event_id, 1, 2) > '01' THEN array_to_string(vehicle_hints, '|') END AS hints, substr(event_id, 1, 2) = '00' AS is_tombstone, substr(event_id, 1, 2) = '01' AS is_corrupt FROM offer_events""",
)
def read_topic(spark, d):
    rows = topics.read_topic(offer_messages(spark, d), "offers.enriched")
    return rows.select("event_id", "payload.price_toman", F.array_join("payload.vehicle_hints", "|").alias("hints"), "is_tombstone", "is_corrupt")


@query(
    "contract_split",
    "offer_events",
    """
  SELECT CASE WHEN event_id >= 'f' OR price_toman = 0 THEN 'dead' ELSE 'good' END AS outcome, CASE WHEN price_toman = 0 AND event_id >= 'f' THEN 'price_toman,stock_status' WHEN event_id >= 'f' THEN 'stock_status' WHEN price_toman = 0 THEN 'price_toman' ELSE '' END AS reason, count(*) AS n
  FROM offer_events WHERE substr(event_id, 1, 2) > '01' GROUP BY ALL""",
)
def contract_split(spark, d):
    rows = topics.read_topic(offer_messages(spark, d), "offers.enriched").where("NOT is_corrupt AND NOT is_tombstone")
    flat = rows.select("event_id", "raw", "payload.*")
    good, dead = topics.contract_split(flat, topics.offer_rules(), "offers.enriched", "raw")
    return good.select(F.lit("good").alias("outcome"), F.lit("").alias("reason")).unionByName(
        dead.select(F.lit("dead").alias("outcome"), "reason")
    ).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dlq_retry",
    "offer_events",
    "SELECT event_id FROM offer_events WHERE event_id >= 'f' AND substr(event_id, 2, 1) < '8'",
)
def dlq_retry(spark, d):
    """Everything dead (twice) is retried; part of it was handled meanwhile.

    What is read of the messages is written once, the whole text only of those that break a rule,
    so no message is made or parsed again for the events handled meanwhile.
    """
    rows = topics.read_topic(offer_messages(spark, d), "offers.enriched").where("NOT is_corrupt AND NOT is_tombstone")
    valid = F.col("stock_status").isin(*schemas.STOCK)
    later = F.substring("event_id", 2, 1) >= "8"
    text = F.when(~F.coalesce(valid, F.lit(False)), F.col("raw")).alias("raw")
    stored = cut_lineage(rows.select("event_id", "raw", "payload.*").select("event_id", "stock_status", text).where(F.col("raw").isNotNull() | later))
    _, dead = topics.contract_split(stored, [("stock_status", valid)], "offers.enriched", "raw")
    handled = stored.select("event_id").where(later)
    retried, _ = topics.dlq_retry(dead.unionByName(dead), handled, "offers.enriched")
    return retried.select("event_id")


PAGE_SPEC = html.SourceSpec(title=html.Pick("h1"), url=html.Pick("a", attribute="href"), fragment_tag="title")


@query(
    "extract_html_listings",
    "",
    r"""
  SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) IS NOT NULL AS parsed FROM pages WHERE regexp_matches(html, '<h1[^>]*>\s*[^<\s]') AND regexp_matches(html, '<a [^>]*href="[^"]')""",
)
def extract_html_listings(spark, d):
    pages = v.table(spark, d, "pages")
    return html.extract_html_listings(pages, PAGE_SPEC).select("page_id", F.col("url").isNotNull().alias("parsed"))


def feed_rows(spark, d):
    p = v.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.when(k % 9 != 0, F.concat(F.lit("id"), k)).alias("id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("title"),
        F.concat(F.lit("/p/"), k).alias("link"), F.col("p_retailprice").cast("string").alias("price"), F.lit("in stock").alias("availability"),
        F.when(k % 2 == 0, F.concat(F.lit("https://cdn.example/"), k, F.lit(".png"))).alias("image_link"),
    )


FEED_SQL = """
  SELECT 'id' || p_partkey AS external_key, 'https://shop.example/p/' || p_partkey AS url, p_name || ', "' || p_brand || '"' AS raw_title,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://cdn.example/' || p_partkey || '.png' END AS image_url FROM part WHERE p_partkey % 9 <> 0"""


@query("read_csv_feed", "", FEED_SQL)
def read_csv_feed(spark, d):
    path = scratch(spark, "csv")
    feed_rows(spark, d).write.option("header", True).option("escape", '"').csv(path)
    out = feeds.read_csv_feed(spark, path, "https://shop.example/feed.csv")
    return out.select("external_key", "url", "raw_title", "image_url")


@query("read_xml_feed", "", FEED_SQL)
def read_xml_feed(spark, d):
    path = scratch(spark, "xml")
    feed_rows(spark, d).write.format("xml").option("rowTag", "item").option("rootTag", "feed").save(path)
    out = feeds.read_xml_feed(spark, path, "https://shop.example/feed.xml")
    return out.select("external_key", "url", "raw_title", "image_url")


@query(
    "write_changed",
    "price_state",
    "SELECT offer_uid, stock_status FROM price_state WHERE substr(offer_uid, 1, 1) IN ('0', '1', '2', '3')",
)
def write_changed(spark, d):
    """Offers 0 and 1 are new, 2 and 3 have another fingerprint, the rest are as published."""
    s = v.price_state(spark, d).select("offer_uid", "stock_status", F.sha2(F.concat_ws("|", "offer_uid", "stock_status"), 256).alias("fp"))
    first = F.substring("offer_uid", 1, 1)
    before = s.where(~first.isin("0", "1")).select("offer_uid", F.when(first.isin("2", "3"), "old").otherwise(F.col("fp")).alias("fp"))
    return topics.write_changed(s, before, "offer_uid", "fp").select("offer_uid", "stock_status")


@query(
    "price_history_sink",
    "points",
    "SELECT strftime(observed_at, '%Y-%m') AS month, count(*) AS points, count(price_toman) AS priced FROM points GROUP BY 1",
)
def price_history_sink(spark, d):
    path = scratch(spark, "history")
    sinks.price_history_sink(cdc.price_change_points(v.price_events(spark, d)), path)
    back = spark.read.option("basePath", path).schema(
        "offer_uid STRING, product_uid STRING, observed_at TIMESTAMP, price_toman BIGINT, stock_status STRING, month STRING"
    ).parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("points"), F.count("price_toman").alias("priced"))


@query(
    "emit_reference",
    "vehicles crossrefs",
    "SELECT 'vehicles.changed' AS topic, vehicle_slug AS key FROM vehicles UNION ALL SELECT 'crossrefs.changed', code_a || '|' || code_b FROM crossrefs",
)
def emit_reference(spark, d):
    from karvan.plans.q_catalog import crossrefs

    return topics.emit_reference(v.vehicles(spark, d), crossrefs(spark, d)).select("topic", "key")


@query(
    "seed_upsert",
    "",
    """
  SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'insert' WHEN p_partkey % 5 = 1 THEN 'kept' WHEN p_partkey % 5 = 2 THEN 'update' ELSE 'unchanged' END AS action,
    CASE WHEN p_partkey % 5 = 2 THEN upper(p_name) ELSE p_name END AS p_name FROM part""",
)
def seed_upsert(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey") % 5
    seed = p.where(k != 1).withColumn("p_name", F.when(k == 2, F.upper("p_name")).otherwise(F.col("p_name")))
    return topics.seed_upsert(p.where(k != 0), seed, "p_partkey").select("p_partkey", "action", "p_name")


@query(
    "csv_report_sink",
    "slog",
    f"""SELECT 'q' || (user_id % 15) AS normalized_text, count(*) AS query_count FROM slog WHERE result_count = 0 AND ts >= TIMESTAMP '{v.CLICK_NOW}' - INTERVAL 7 DAY GROUP BY 1""",
)
def csv_report_sink(spark, d):
    from karvan.operators import search
    from karvan.plans.q_search import query_log

    path = scratch(spark, "report")
    report = search.zero_result_report(query_log(spark, d), v.as_of(v.CLICK_NOW))
    total = report.groupBy("normalized_text").agg(F.sum("query_count").alias("query_count"))
    sinks.csv_report_sink(total.orderBy(F.desc("query_count"), "normalized_text"), path)
    return spark.read.schema("normalized_text STRING, query_count BIGINT").option("header", True).csv(path)

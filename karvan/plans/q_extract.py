"""Extraction queries. Listings are composed from lineitem rows, so the oracle can
state the expected fields straight from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import extract, ranking
from karvan.plans import views as v
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage

TYPES = ("لنت ترمز جلو", "واتر پمپ", "فیلتر روغن", "کمک فنر عقب", "تسمه تایم", "شمع", "دیسک ترمز", "رادیاتور")
ALIASES = ("bosch", "Valeo", "ايساكو", "saipa yadak", "denso", "kyb", "عظام", "gates")
CANONICAL = ("بوش", "والئو", "ایساکو", "سایپا یدک", "دنسو", "کایابا", "عظام", "گیتس")
GRADE_WORDS = ("اصلی", "استوک", "متفرقه", "OEM", "")
GRADES = ("genuine", "used", "aftermarket", "oem", "unknown")
CARS = ("پژو ۲۰۶ تیپ ۵", "پژو 405", "سمند EF7")
HINTS = ("پژو 206 تیپ 5", "پژو 405", "سمند EF7")
PACKS = ("بسته ۴ عددی", "جفت", "", "6 تایی")
QUANTITIES = (4, 2, 1, 6)
PRICES = ("450,000 تومان", "۴٬۵۰۰٬۰۰۰ ریال", "450000", "4500000", "77", "2 میلیون تومان", None)
TOMAN = (450000, 450000, 450000, 450000, None, 2000000, None)
STOCKS = ("موجود در انبار", "ناموجود", None, "In Stock")
STATUSES = ("in_stock", "out_of_stock", "unknown", "in_stock")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def _sql(values) -> str:
    cells = ["NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in values]
    return "([" + ", ".join(cells) + "])"


def listings(spark, d):
    li = v.spread(v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate"))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    slot = F.floor(pk / 8) % 8
    code = F.concat(F.lit("PN-"), pk + 10000)
    body = F.concat_ws(
        " ",
        _pick(TYPES, pk % 8),
        _pick(ALIASES, slot),
        F.when(sk % 7 == 0, "131"),
        _pick(GRADE_WORDS, sk % 5),
        _pick(CARS, sk % 3),
        F.when(ln != 4, F.lit("کد")),
        F.when(ln != 5, code),
        _pick(PACKS, pk % 4),
        F.lit("فقط 450,000 تومان"),
        F.when(ln == 3, "برای پژو پارس نیست").when(ln == 2, "مناسب تمام پژوها"),
        F.lit("۰۹۱۲۱۲۳۴۵۶۷"),
    )
    event = F.concat_ws("|", F.unix_micros(F.col("l_shipdate").cast("timestamp")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        F.sha2(event, 256).alias("listing_id"),
        body.alias("text"),
        F.concat(F.lit("s"), sk % 100).alias("seller_key"),
        _pick(PRICES, pk % 7).alias("raw_price_text"),
        _pick(STOCKS, sk % 4).alias("raw_stock_text"),
        F.col("l_shipdate").cast("timestamp").alias("called_at"),
    )


add_view(
    "truth",
    "price_events",
    f"""
  SELECT event_id AS listing_id, occurred_at, seller_key, part_key, supp_key, line_no, {_sql(TYPES)}[part_key % 8 + 1] AS part_type,
    CASE WHEN supp_key % 7 <> 0 THEN {_sql(CANONICAL)}[(part_key // 8) % 8 + 1] WHEN (part_key // 8) % 8 = 3 THEN 'سایپا' END AS brand,
    {_sql(GRADES)}[supp_key % 5 + 1] AS authenticity_claim, {_sql(HINTS)}[supp_key % 3 + 1] AS hint,
    CASE WHEN line_no <> 5 THEN 'PN-' || (part_key + 10000) END AS part_number,
    CASE WHEN line_no = 5 THEN 0e0 WHEN line_no = 4 THEN 0.85e0 ELSE 0.95e0 END AS part_number_confidence,
    CAST({_sql(QUANTITIES)}[part_key % 4 + 1] AS BIGINT) AS pack_quantity
  FROM price_events""",
)


@query("extract_brand", "truth", "SELECT listing_id, brand, CASE WHEN brand IS NULL THEN 0e0 ELSE 0.9e0 END AS confidence FROM truth")
def extract_brand(spark, d):
    x = extract.extract_brand(F.col("text"))
    return listings(spark, d).select("listing_id", x.alias("x")).select("listing_id", "x.brand", "x.confidence")


@query("extract_part_number", "truth", "SELECT listing_id, part_number, part_number_confidence AS confidence FROM truth")
def extract_part_number(spark, d):
    x = extract.extract_part_number(F.col("text"))
    return listings(spark, d).select("listing_id", x.alias("x")).select("listing_id", "x.part_number", "x.confidence")


@query("extract_part_type", "truth", "SELECT listing_id, part_type FROM truth")
def extract_part_type(spark, d):
    return listings(spark, d).select("listing_id", extract.extract_part_type(F.col("text"))["part_type"].alias("part_type"))


@query("extract_authenticity", "truth", "SELECT listing_id, authenticity_claim FROM truth")
def extract_authenticity(spark, d):
    x = extract.extract_authenticity(F.col("text"))
    return listings(spark, d).select("listing_id", x["authenticity_claim"].alias("authenticity_claim"))


@query("extract_pack_quantity", "truth", "SELECT listing_id, pack_quantity FROM truth")
def extract_pack_quantity(spark, d):
    return listings(spark, d).select("listing_id", extract.extract_pack_quantity(F.col("text"))["pack_quantity"].alias("pack_quantity"))


@query(
    "extract_price",
    "truth",
    f"""SELECT listing_id, CAST({_sql(TOMAN)}[part_key % 7 + 1] AS BIGINT) AS price_toman, part_key % 7 = 4 AS needs_review FROM truth""",
)
def extract_price(spark, d):
    x = extract.extract_price(F.col("raw_price_text"), F.lit(100_000), F.lit(900_000))
    rows = listings(spark, d).select(F.col("listing_id").alias("offer_uid"), x.alias("price"))
    reviews = extract.price_reviews(rows).select("offer_uid", F.lit(True).alias("r"))
    return rows.join(reviews, "offer_uid", "left").select(
        F.col("offer_uid").alias("listing_id"), "price.price_toman",
        F.coalesce("r", F.lit(False)).alias("needs_review"),
    )


@query("extract_stock", "truth", f"SELECT listing_id, {_sql(STATUSES)}[supp_key % 4 + 1] AS stock_status FROM truth")
def extract_stock(spark, d):
    return listings(spark, d).select("listing_id", extract.extract_stock(F.col("raw_stock_text")).alias("stock_status"))


@query(
    "extract_vehicle_hints",
    "truth",
    """SELECT listing_id, CASE WHEN line_no <> 3 THEN hint WHEN hint LIKE 'سمند%' THEN 'پژو پارس|' || hint ELSE hint || '|پژو پارس' END AS hints FROM truth""",
)
def extract_vehicle_hints(spark, d):
    return listings(spark, d).select("listing_id", F.array_join(extract.extract_vehicle_hints(F.col("text")), "|").alias("hints"))


@query(
    "extract_overbroad_excluded",
    "truth",
    """SELECT listing_id, line_no = 2 AS overbroad_claim, hint AS hints, CASE WHEN line_no = 3 THEN 'پژو پارس' ELSE '' END AS excluded FROM truth""",
)
def extract_overbroad_excluded(spark, d):
    x = extract.extract_overbroad_excluded(F.col("text"))
    rows = listings(spark, d).select("listing_id", x.alias("x"))
    return rows.select(
        "listing_id", "x.overbroad_claim", F.array_join("x.vehicle_hints", "|").alias("hints"),
        F.array_join("x.vehicle_hints_excluded", "|").alias("excluded"),
    )


@query(
    "confidence_envelope",
    "price_events",
    """
  SELECT event_id, CASE WHEN price_toman IS NULL THEN 0e0 ELSE CASE WHEN line_no % 2 = 0 THEN 0.5e0 ELSE least(1e0, part_key / 1000e0) END END AS price,
    CASE WHEN stock_status = 'unknown' THEN 0e0 ELSE 0.5e0 END AS stock, CAST(2 AS BIGINT) AS n_fields FROM price_events""",
)
def confidence_envelope(spark, d):
    e = v.price_events(spark, d)
    filled = F.create_map(F.lit("price"), F.col("price_toman").isNotNull(), F.lit("stock"), F.col("stock_status") != "unknown")
    claimed = F.create_map(
        F.lit("price"), F.when(F.col("line_no") % 2 != 0, F.col("part_key") / 1000.0),
        F.lit("extra"), F.lit(0.3),
    )
    m = extract.confidence_envelope(filled, claimed, ["price", "stock"])
    return e.select("event_id", m.alias("m")).select(
        "event_id", F.col("m.price"), F.col("m.stock"), F.size("m").cast("long").alias("n_fields")
    )


@query(
    "cascade_route",
    "truth",
    """
  WITH r AS (SELECT *, brand IS NOT NULL AND part_number IS NOT NULL AS sure FROM truth),
  m AS (SELECT *, coalesce(sum(40) OVER (PARTITION BY CAST(occurred_at AS DATE) ORDER BY occurred_at, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WHERE NOT sure)
  SELECT r.listing_id, CASE WHEN r.sure OR spent >= 100 THEN 'rules' ELSE 'model' END AS route, coalesce(spent >= 100, false) AS needs_reprocess
  FROM r LEFT JOIN m USING (listing_id)""",
)
def cascade_route(spark, d):
    routed = extract.cascade_route(extract.extract_offer_fields(listings(spark, d)))
    routed = cut_lineage(routed.select("listing_id", "called_at", "route"))  # extract once
    calls = routed.where("route = 'model'").select(F.col("listing_id").alias("call_id"), "called_at", F.lit(40).cast("long").alias("cost"))
    admitted = ranking.budget_admission(calls, 100).withColumnRenamed("call_id", "listing_id")
    return extract.apply_budget(routed, admitted, "listing_id").select("listing_id", "route", "needs_reprocess")


@query(
    "response_cache_join",
    "offer_events",
    """
  WITH k AS (SELECT sha256('stub' || chr(31) || 'm1' || chr(31) || 'v1' || chr(31) || 'extract' || chr(31) || title_normalized || chr(31)) AS cache_key,
      title_normalized AS payload, count(*) AS asked FROM offer_events GROUP BY title_normalized)
  SELECT cache_key, payload, asked, substr(cache_key, 1, 1) < '8' AS is_hit FROM k""",
)
def response_cache_join(spark, d):
    """About half of the answers are already in the cache table."""
    asked = v.offer_events(spark, d).select(
        F.lit("stub").alias("backend"), F.lit("m1").alias("model"), F.col("title_normalized").alias("payload")
    )
    empty = spark.createDataFrame([], "cache_key string, answer string")
    first = extract.response_cache_join(asked, empty, "extract", "v1")
    cache = first.where(F.substring("cache_key", 1, 1) < "8").select("cache_key", F.lit("{}").alias("answer"))
    out = extract.response_cache_join(asked, cache, "extract", "v1")
    return out.select("cache_key", "payload", "asked", "is_hit")


@query(
    "synonym_mining",
    "offers",
    """
  WITH t AS (SELECT DISTINCT offer_uid, seller_key, part_type, unnest(string_split(lower(title_normalized), ' ')) AS token FROM offers WHERE part_type IS NOT NULL),
  f AS (SELECT * FROM t WHERE token NOT IN ('ring', 'plate') AND NOT regexp_matches(token, '[0-9]')),
  c AS (SELECT token, part_type, count(*) AS count, count(DISTINCT seller_key) AS sellers FROM f GROUP BY ALL),
  s AS (SELECT *, sum(count) OVER (PARTITION BY token) AS total FROM c)
  SELECT token, part_type, count, sellers, round(count / total, 6) AS ratio FROM s
  WHERE count >= 5 AND sellers >= 2 AND count / total >= 0.6e0 AND NOT (token = 'promo' AND part_type = 'promo')""",
)
def synonym_mining(spark, d):
    o = v.offers(spark, d).withColumnRenamed("title_normalized", "title")
    vocabulary = spark.createDataFrame([("ring",), ("plate",)], "token string")
    rejected = spark.createDataFrame([("promo", "promo")], "token string, part_type string")
    out = extract.synonym_mining(o, vocabulary, rejected)
    return out.select("token", "part_type", "count", "sellers", F.bround("ratio", 6).alias("ratio"))


@query(
    "extraction_quality",
    "truth",
    """
  SELECT count(*) AS listings, round(avg((brand IS NOT NULL)::INT), 6) AS brand_coverage, 1e0 AS part_type_coverage,
    round(avg((brand IS NOT NULL AND part_number IS NOT NULL)::INT), 6) AS rules_share, 1e0 AS brand_accuracy, 1e0 AS part_number_accuracy FROM truth""",
)
def extraction_quality(spark, d):
    rows = listings(spark, d)
    e = v.price_events(spark, d)
    slot = F.floor(F.col("part_key") / 8) % 8
    brand = F.when(F.col("supp_key") % 7 != 0, _pick(CANONICAL, slot)).when(slot == 3, "سایپا")
    number = F.when(F.col("line_no") != 5, F.concat(F.lit("PN-"), F.col("part_key") + 10000))
    truth = e.select(F.col("event_id").alias("listing_id"), brand.alias("brand"), number.alias("part_number"))
    out = extract.extraction_quality(extract.extract_offer_fields(rows), truth)
    rounded = [F.bround(c, 6).alias(c) for c in out.columns if c != "listings"]
    return out.select("listings", *rounded)

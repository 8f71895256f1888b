"""Prices, charges and fraud windows where a wrong answer costs money."""

import datetime as dt

from pyspark.sql import functions as F

from karvan.functions.titles import contains_promotional, strip_promotional
from karvan.operators import billing, cdc, extract, ops


def _at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_prices_with_decimals_and_doubts(spark):
    cases = {
        "2.5 میلیون تومان": (2_500_000, "unit_toman"),
        "1,5 میلیون تومان": (1_500_000, "unit_toman"),
        "۲٫۵ میلیون تومان": (2_500_000, "unit_toman"),
        "450,000 تومان": (450_000, "unit_toman"),
        "4.500.000 ریال": (450_000, "unit_rial"),
        "12.3456 میلیون تومان": (None, "ambiguous"),
        "99999999999999999999 تومان": (None, "ambiguous"),
        "تماس بگیرید": (None, "absent"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "raw string").select("raw", extract.extract_price(F.col("raw"), F.lit(100_000), F.lit(900_000)).alias("p")).collect()
    assert {r.raw: (r.p.price_toman, r.p.rule) for r in rows} == cases


def test_stock_needs_whole_words(spark):
    cases = {"available": "in_stock", "unavailable": "out_of_stock", "not available now": "out_of_stock", "Not in stock": "out_of_stock", "موجود": "in_stock", "ناموجود": "out_of_stock"}
    rows = spark.createDataFrame([(t,) for t in cases], "raw string").select("raw", extract.extract_stock(F.col("raw")).alias("s")).collect()
    assert {r.raw: r.s for r in rows} == cases


def test_redelivered_click_is_charged_once(spark):
    click = (1, "s1", _at(10), True, False, 100)
    clicks = spark.createDataFrame([click, click, (2, "s1", _at(20), True, False, 100)], "click_id long, seller_key string, occurred_at timestamp, is_panel_offer boolean, is_suspicious boolean, rate_cost long")
    topups = spark.createDataFrame([(1, "s1", _at(0), 1000)], "topup_id long, seller_key string, occurred_at timestamp, amount_toman long")
    ledger = billing.wallet_charge(billing.ledger_events(clicks, topups)).orderBy("occurred_us").collect()
    assert [r.balance_after_toman for r in ledger] == [1000, 900, 800]


def test_clicks_without_an_address_share_no_window(spark):
    rows = [(i, "s1", None, _at(i * 86_400 * 30)) for i in range(12)]
    clicks = spark.createDataFrame(rows, "click_id long, seller_key string, ip_hash string, occurred_at timestamp")
    assert not any(r.ip_rate_limit for r in billing.anchored_rate_limit(clicks).collect())


def test_long_phrases_go_whole(spark):
    rows = spark.createDataFrame([("گارانتی اصالت کالا تضمینی لنت ترمز",), ("◆ لنت ترمز ◆",)], "t string")
    got = [r[0] for r in rows.select(strip_promotional(F.col("t"))).collect()]
    assert "تضمینی" not in got[0] and got[1] == "لنت ترمز"
    assert all(r[0] for r in rows.select(contains_promotional(F.col("t"))).collect())


def test_versions_compare_as_numbers(spark):
    offers = spark.createDataFrame([("a", "v9", _at(0)), ("b", "v10", _at(0)), ("c", "v2", _at(0))], "offer_uid string, normalizer_version string, first_seen_at timestamp")
    again = offers.select("offer_uid", "first_seen_at")
    assert sorted(r.offer_uid for r in cdc.reprocess_stale(offers, again, "v10").collect()) == ["a", "c"]


def test_busy_topic_is_healthy_and_a_lagging_one_is_not(spark):
    events = spark.range(60_001).select(F.lit("busy").alias("topic"), F.col("id").alias("event_id"), F.lit(_at(5)).alias("occurred_at"), F.lit(False).alias("is_late"))
    one = spark.createDataFrame([("slow", 1, _at(5), False)], "topic string, event_id long, occurred_at timestamp, is_late boolean")
    dead = spark.createDataFrame([], "topic string, failed_at timestamp")
    lag = [("slow", "g", _at(60 * m), 60_000) for m in range(15)] + [("busy", "g", _at(60 * m), 60_000 if m else 10) for m in range(15)]
    lags = spark.createDataFrame(lag, "topic string, consumer_group string, measured_at timestamp, lag long")
    out = {r.topic: r.alarm for r in ops.pipeline_health(events.unionByName(one), dead, lags).collect()}
    assert out == {"busy": False, "slow": True}

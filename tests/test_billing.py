from pyspark.sql import functions as F

from karvan.operators import billing, extract

SCHEMA = "seller_key string, event_id long, occurred_us long, prio int, kind string, amount_toman long"


def run(spark, rows, hot=10**9):
    df = spark.createDataFrame(rows, SCHEMA)
    out = billing.wallet_charge(df, hot).orderBy("seller_key", "occurred_us", "event_id").collect()
    return [(r["kind"], r["amount_toman"], r["balance_after_toman"], r["panel_offers_active"], r["reason"]) for r in out]


def test_wallet_rules(spark):
    rows = [
        ("s", 1, 10, 0, "topup", 1000), ("s", 2, 20, 2, "charge", -600), ("s", 3, 30, 2, "charge", -600),
        ("s", 4, 40, 2, "charge", -100), ("s", 5, 50, 0, "topup", 200), ("s", 6, 60, 2, "charge", -600),
        ("s", 7, 70, 1, "manual", -500), ("s", 8, 80, 0, "topup", 100), ("s", 9, 90, 2, "charge", -700),
    ]
    assert run(spark, rows) == [
        ("topup", 1000, 1000, True, None),
        ("charge", -600, 400, True, None),
        ("charge", 0, 400, False, "insufficient_balance"),
        ("charge", 0, 400, False, None),
        ("topup", 200, 600, True, None),
        ("charge", -600, 0, False, "zero_balance"),
        ("manual", 0, 0, False, "would_go_negative"),
        ("topup", 100, 100, True, None),
        ("charge", 0, 100, False, "insufficient_balance"),
    ]


def test_solvent_seller_is_a_running_sum(spark):
    rows = [("s", 0, 0, 0, "topup", 10_000)] + [("s", i, i * 40_000_000_000, 2, "charge", -100) for i in range(1, 40)]
    for hot in (5, 10**9):
        got = run(spark, rows, hot)
        assert [g[2] for g in got] == [10_000 - 100 * i for i in range(40)]


def test_privacy_drops_raw_values(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "agent")], "click_id long, ip_address string, user_agent string")
    assert {"ip_address", "user_agent"}.isdisjoint(billing.pseudonymize_clicks(df, "k").columns)


def test_price_never_guesses(spark):
    rows = [("300,000 تومان",), ("۳٬۰۰۰٬۰۰۰ ریال",), ("300000",), ("3000000",), ("5",), ("300000000",), (None,), ("2.5 میلیون",)]
    df = spark.createDataFrame(rows, "t string").select(extract.extract_price(F.col("t"), F.lit(100_000), F.lit(900_000)).alias("p"))
    got = [(r["p"]["price_toman"], r["p"]["rule"]) for r in df.collect()]
    assert got[:7] == [(300000, "unit_toman"), (300000, "unit_rial"), (300000, "band_toman"), (300000, "band_rial"), (None, "ambiguous"), (None, "ambiguous"), (None, "absent")]

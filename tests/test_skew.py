"""The hot-key path must give what the plain path gives."""

import random

from pyspark.sql import functions as F

from karvan.operators import cdc, ranking, skew

HOT = 5


def events(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}"
        rows.append((key, rng.randrange(40) * 20_000 + rng.randrange(3), f"e{i:04d}", rng.randrange(3)))
    df = spark.createDataFrame(rows, "k string, s long, id string, v long")
    return df.withColumn("at", F.timestamp_seconds("s")).cache(), rows


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_lag(spark):
    df, _ = events(spark)
    run = lambda hot: skew.lag_in_key(df, ["k"], ["at", "id"], {"p": "v"}, skew.day_chunk("at"), hot, "seen", True).select("k", "id", "p", "seen")
    assert as_set(run(HOT).fillna(-1)) == as_set(run(10**9).fillna(-1))


def test_prefix_sum(spark):
    df, rows = events(spark)
    run = lambda hot: skew.prefix_sum_in_key(df, ["k"], ["at", "id"], F.col("v"), "before", skew.day_chunk("at"), hot).select("id", "before")
    total, want = {}, []
    for k, _, i, val in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want.append((i, total.get(k, 0)))
        total[k] = total.get(k, 0) + val
    assert as_set(run(HOT)) == sorted(want) == as_set(run(10**9))


def test_anchored_windows(spark):
    for seed, ttl in ((1, 30_000), (2, 90_000), (3, 700)):
        df, rows = events(spark, seed)
        want, start = [], {}
        for k, s, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            if k not in start or s >= start[k] + ttl:
                start[k] = s
            want.append((i, start[k] * 1_000_000))
        for hot in (HOT, 10**9):
            got = skew.anchored_windows(df, ["k"], "at", ttl, 86_400, hot).select("id", "window_start_us")
            assert as_set(got) == sorted(want)


def test_cdc_fragment(spark):
    df, _ = events(spark)
    rows = df.withColumnRenamed("v", "h")
    run = lambda hot: cdc.cdc_fragment(rows, ["k"], "h", "at", "id", hot).select("k", "id", F.unix_timestamp("last_seen_at"))
    assert as_set(run(HOT)) == as_set(run(10**9))


def test_rank_offers(spark):
    rng = random.Random(5)
    rows = [("p" if rng.random() < 0.6 else f"q{rng.randrange(5)}", f"o{i}", rng.randrange(20) / 20, rng.choice([None, 1000, 2000, 5000]), rng.choice(["in_stock", "unknown", "out_of_stock"])) for i in range(150)]
    df = spark.createDataFrame(rows, "product_uid string, offer_uid string, trust_score double, price_toman long, stock_status string")
    df = df.withColumn("last_seen_at", F.timestamp_seconds(F.lit(1_000_000)))
    now = F.timestamp_seconds(F.lit(1_100_000))
    run = lambda hot: ranking.rank_offers(df, now, hot_rows=hot).select("offer_uid", "rank_position", "rank_score")
    assert as_set(run(HOT)) == as_set(run(10**9))


def test_trust_beats_price(spark):
    rows = [("p", "a", 0.9, 5000, "in_stock"), ("p", "b", 0.6, 1000, "in_stock"), ("p", "c", 0.6, 900, "in_stock"), ("p", "d", 0.62, None, "unknown")]
    df = spark.createDataFrame(rows, "product_uid string, offer_uid string, trust_score double, price_toman long, stock_status string")
    df = df.withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    out = ranking.rank_offers(df, F.timestamp_seconds(F.lit(0))).orderBy("rank_position").collect()
    assert [r["offer_uid"] for r in out] == ["a", "c", "b", "d"]
    assert out[0]["trust_band"] == 18 and out[1]["trust_band"] == 12


def test_debounce_drops_reverted_content(spark):
    rows = [("p", 0, "e1", "a"), ("p", 10, "e2", "b"), ("p", 100, "e3", "c"), ("p", 110, "e4", "b"), ("p", 300, "e5", "d")]
    df = spark.createDataFrame(rows, "k string, s long, event_id string, h string").withColumn("occurred_at", F.timestamp_seconds("s"))
    out = cdc.debounced_emission(df, "k", "h").orderBy("emitted_at").collect()
    assert [(r["emitted_at"].timestamp(), r["h"]) for r in out] == [(60.0, "b"), (360.0, "d")]

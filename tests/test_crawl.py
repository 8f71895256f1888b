"""Crawl tiers on odd rows, and in one pass."""

import datetime as dt

from pyspark.sql import functions as F

from karvan.operators import crawl

NOW = dt.datetime(2024, 3, 31)


def test_tiers_of_shared_and_missing_urls_in_one_pass(spark):
    ago = lambda n: NOW - dt.timedelta(days=n)
    rows = [
        ("s", "hot", "o1", "u1", "5", 40), ("s", "warm", "o2", "u2", "5", 3), ("s", "warm", "o2", "u2", "6", 2),
        ("s", "cold", "o3", "u3", "5", 10), ("s", "twin a", "o4", "u4", "5", 9), ("s", "twin b", "o1", "u4", "5", 50),
        ("s", "no url a", "o5", None, "5", 8), ("s", "no url b", "o1", None, "5", 8), ("s", "old", "o6", "u6", "5", 90),
        ("s", None, "o7", "u7", "5", 1), ("s", None, "o7", "u7", "6", 2),
    ]
    seen = [(s, k, o, u, p, ago(n), ago(n), i) for i, (s, k, o, u, p, n) in enumerate(rows)]
    obs = spark.createDataFrame(seen, "source string, external_key string, offer_uid string, url string, raw_price_text string, observed_at timestamp, last_seen_at timestamp, id long")
    signals = spark.createDataFrame([("o1", 3, ago(1)), ("o1", 1, ago(2)), ("o3", 0, ago(1)), ("o3", 2, ago(9))], "offer_uid string, count_7d int, updated_at timestamp")
    out = crawl.crawl_tiers(obs, signals, F.lit(NOW))
    got = sorted((r.url or "", r.tier) for r in out.collect())
    assert got == sorted([
        ("u1", "hot"), ("u1", "dormant"), ("u2", "warm"), ("u3", "cold"), ("u4", "hot"), ("u4", "dormant"),
        ("", "hot"), ("", "cold"), ("", "cold"), ("u6", "dormant"), ("u7", "cold"),
    ])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") == 1

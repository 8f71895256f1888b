"""Price statistics, history and trust queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import cdc, pricing, trust
from karvan.plans import views as v
from karvan.plans.q_cdc import CHANGE_POINTS
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view

add_view("points", "price_events", CHANGE_POINTS)
add_view(
    "seller_obs",
    "price_events",
    """
  SELECT seller_key,
    count(*) FILTER (WHERE ps IS NOT NULL AND pp IS NOT NULL AND price_toman IS NOT NULL) AS price_observations,
    count(*) FILTER (WHERE ps IS NOT NULL AND pp = price_toman) AS price_hits,
    count(*) FILTER (WHERE ps = 'in_stock') AS stock_observations,
    count(*) FILTER (WHERE ps = 'in_stock' AND stock_status = 'in_stock') AS stock_hits
  FROM (SELECT *, lag(price_toman) OVER w AS pp, lag(stock_status) OVER w AS ps FROM (
      SELECT * FROM price_events
      QUALIFY row_number() OVER (PARTITION BY offer_uid, occurred_at ORDER BY event_id DESC) = 1)
    WINDOW w AS (PARTITION BY offer_uid ORDER BY occurred_at)) GROUP BY seller_key""",
)
add_view(
    "seller_scored",
    "seller_obs sellers",
    """
  SELECT s.*, o.price_observations, o.price_hits, o.stock_observations, o.stock_hits,
    CASE WHEN price_observations <= 0 THEN 0.5e0 ELSE (price_hits + 2.5e0) / (price_observations + 5e0) END AS pa,
    CASE WHEN stock_observations <= 0 THEN 0.5e0 ELSE (stock_hits + 2.5e0) / (stock_observations + 5e0) END AS sa,
    least(price_observations, stock_observations) AS seen
  FROM sellers s JOIN seller_obs o USING (seller_key)""",
)
add_view(
    "seller_trust",
    "seller_scored",
    """
  SELECT seller_key, is_panel, new_tier AS tier,
    round_even(least(greatest(0e0, least(1e0, raw)), CASE new_tier WHEN 'new' THEN 0.45e0 WHEN 'standard' THEN 0.8e0
      WHEN 'trusted' THEN 1e0 ELSE 0.15e0 END), 4) AS trust_score,
    CASE WHEN price_observations >= 10 THEN round_even(pa, 4) END AS price_accuracy,
    CASE WHEN stock_observations >= 10 THEN round_even(sa, 4) END AS stock_accuracy
  FROM (SELECT *, CASE WHEN tier_override IS NOT NULL THEN tier_override WHEN tier = 'suspended' THEN 'suspended'
      WHEN seen < 10 THEN 'new' WHEN seen >= 50 AND pa >= 0.9e0 AND sa >= 0.9e0 THEN 'trusted' ELSE 'standard' END AS new_tier,
    (0.4e0 * pa + 0.3e0 * sa + 0.1e0 * CAST(is_panel AS INT)
      + 0.08e0 * CASE WHEN domain_age_days IS NULL THEN 0.5e0 ELSE least(1e0, domain_age_days / 730e0) END
      + 0.07e0 * coalesce(contact_completeness, 0.5e0)
      + 0.05e0 * coalesce(CAST(CAST(has_trust_badge AS INT) AS DOUBLE), 0.5e0)) AS raw FROM seller_scored)""",
)


def observed(spark, d):
    """Observations from the stored columns of the lines."""
    return trust.trust_observations(v.offer_lines(spark, d), offer=v.OFFER, describe=v.with_facts)


def seller_trust(spark, d):
    obs = observed(spark, d)
    return trust.trust_score(v.sellers(spark, d).join(obs, "seller_key"))


MEDIAN = "CAST(floor(quantile_cont(CAST({0} AS DOUBLE), 0.5) + 0.5) AS BIGINT)"


@query(
    "price_stats",
    "price_state",
    f"""
  SELECT product_uid, min(p) AS min_price_toman, max(p) AS max_price_toman, {MEDIAN.format("p")} AS median_price_toman
  FROM (SELECT product_uid, CASE WHEN stock_status = 'in_stock' THEN price_toman END AS p FROM price_state WHERE is_active)
  GROUP BY product_uid""",
)
def price_stats(spark, d):
    return pricing.price_stats(v.price_state(spark, d).where("is_active"))


@query(
    "price_history_scope",
    "points",
    """
  SELECT DISTINCT product_uid, offer_uid, CAST(epoch(observed_at) AS BIGINT) AS observed_at, price_toman, stock_status FROM (
    SELECT CASE WHEN substr(offer_uid, 1, 1) = '0' THEN 'moved' ELSE product_uid END AS product_uid, offer_uid, observed_at, price_toman, stock_status FROM points
    UNION ALL SELECT product_uid, offer_uid, observed_at, price_toman, stock_status FROM points)""",
)
def price_history_scope(spark, d):
    """Offers whose uid starts with 0 now belong to another product; the tag stays."""
    points = cdc.price_change_points(v.price_events(spark, d))
    moved = F.when(F.col("offer_uid").startswith("0"), "moved").otherwise(F.col("product_uid"))
    members = (
        v.price_events(spark, d).select("offer_uid", "product_uid").distinct().withColumn("product_uid", moved)
    )
    out = pricing.price_history_scope(points, members)
    return out.withColumn("observed_at", F.unix_timestamp("observed_at"))


@query(
    "daily_price_series",
    "points",
    f"""
  WITH days AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '{v.SERIES_FROM}', DATE '{v.SERIES_TO}' + INTERVAL 1 DAY, INTERVAL 1 DAY)),
  s AS (SELECT *, CAST(observed_at AS DATE) AS since,
    coalesce(CAST(lead(observed_at) OVER (PARTITION BY offer_uid ORDER BY observed_at) AS DATE), DATE '2100-01-01') AS until FROM points)
  SELECT product_uid, CAST(date AS VARCHAR) AS date, min(price_toman) AS min_toman, {MEDIAN.format("price_toman")} AS median_toman
  FROM s JOIN days ON date >= since AND date < until
  WHERE price_toman IS NOT NULL AND stock_status = 'in_stock' GROUP BY product_uid, date""",
)
def daily_price_series(spark, d):
    points = cdc.price_change_points(v.offer_lines(spark, d), offer=v.OFFER, describe=v.with_facts)
    out = pricing.daily_price_series(points, v.SERIES_FROM, v.SERIES_TO, v.OFFER)
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "trust_observations",
    "seller_obs",
    "SELECT seller_key, price_observations, price_hits, stock_observations, stock_hits FROM seller_obs",
)
def trust_observations(spark, d):
    return observed(spark, d)


@query(
    "trust_score",
    "seller_trust",
    "SELECT seller_key, tier, trust_score, price_accuracy, stock_accuracy FROM seller_trust",
)
def trust_score(spark, d):
    return seller_trust(spark, d).select(
        "seller_key", "tier", "trust_score", "price_accuracy", "stock_accuracy"
    )


@query(
    "smoothed_accuracy",
    "seller_scored",
    """SELECT seller_key, round(pa, 6) AS price_smoothed, round(sa, 6) AS stock_smoothed,
    round(CASE WHEN domain_age_days IS NULL THEN 0.5e0 ELSE least(1e0, domain_age_days / 730e0) END, 6) AS domain_age_score
    FROM seller_scored""",
)
def smoothed_accuracy(spark, d):
    obs = observed(spark, d)
    joined = v.sellers(spark, d).join(obs, "seller_key")
    smooth = lambda a, b: F.bround(trust.smoothed_accuracy(F.col(a), F.col(b), 0.5, 5.0), 6)
    return joined.select(
        "seller_key",
        smooth("price_hits", "price_observations").alias("price_smoothed"),
        smooth("stock_hits", "stock_observations").alias("stock_smoothed"),
        F.bround(trust.domain_age_score(F.col("domain_age_days"), 0.5), 6).alias("domain_age_score"),
    )


@query(
    "domain_age_score",
    "sellers",
    """SELECT seller_key, round(CASE WHEN domain_age_days IS NULL THEN 0.5e0 ELSE least(1e0, domain_age_days / 730e0) END, 6) AS score FROM sellers""",
)
def domain_age_score(spark, d):
    score = trust.domain_age_score(F.col("domain_age_days"), 0.5)
    return v.sellers(spark, d).select("seller_key", F.bround(score, 6).alias("score"))


@query(
    "changed_sellers",
    "seller_trust price_state",
    """
  WITH c AS (SELECT seller_key FROM seller_trust WHERE substr(sha256(seller_key), 1, 1) < '8' AND trust_score <> 0.3e0)
  SELECT product_uid, count(DISTINCT seller_key) AS changed_sellers FROM price_state JOIN c USING (seller_key) GROUP BY product_uid""",
)
def changed_sellers(spark, d):
    """The previous snapshot had another score (0.3) for about half of the sellers."""
    now = seller_trust(spark, d).select("seller_key", "trust_score", "tier", "price_accuracy", "stock_accuracy")
    half = F.substring(F.sha2("seller_key", 256), 1, 1) < "8"
    before = now.withColumn("trust_score", F.when(half, 0.3).otherwise(F.col("trust_score")))
    changed = trust.changed_sellers(now, before)
    offers = v.price_state(spark, d).select("seller_key", "product_uid").distinct()
    rebuild = trust.products_to_rebuild(changed, offers)
    return (
        offers.join(rebuild, "product_uid", "left_semi")
        .join(changed.select("seller_key"), "seller_key", "left_semi")
        .groupBy("product_uid")
        .agg(F.count(F.lit(1)).alias("changed_sellers"))
    )


@query(
    "seller_view_cap",
    "seller_trust",
    "SELECT seller_key, CASE WHEN is_panel THEN trust_score ELSE least(trust_score, 0.4e0) END AS effective_trust FROM seller_trust",
)
def seller_view_cap(spark, d):
    t = seller_trust(spark, d)
    cap = trust.seller_view_cap(F.col("trust_score"), F.col("is_panel"), 0.4)
    return t.select("seller_key", cap.alias("effective_trust"))


@query(
    "seller_profile",
    "price_state",
    """
  SELECT seller_key, count(*) AS active_offers, count(*) FILTER (WHERE stock_status = 'in_stock') AS in_stock_offers,
    count(DISTINCT product_uid) AS active_products FROM price_state WHERE is_active GROUP BY seller_key""",
)
def seller_profile(spark, d):
    return trust.seller_profile(v.price_state(spark, d))


@query(
    "aggregate_offer_view",
    "price_state",
    """
  SELECT product_uid, min(p) AS low_price, max(p) AS high_price, 'IRT' AS currency, count(*) AS offer_count
  FROM (SELECT product_uid, CASE WHEN stock_status = 'in_stock' THEN price_toman END AS p FROM price_state WHERE is_active) GROUP BY product_uid""",
)
def aggregate_offer_view(spark, d):
    from karvan.operators import feeds

    return feeds.aggregate_offer_view(v.price_state(spark, d).where("is_active"))

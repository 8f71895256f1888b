"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import pricing, ranking
from karvan.plans import views as v
from karvan.plans.q_history import MEDIAN, seller_trust
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage

add_view(
    "scored_offers",
    "price_state seller_trust",
    f"""
  SELECT *, CAST(floor(greatest(0e0, least(1e0, trust_score)) / 0.05e0 + 1e-9) AS BIGINT) AS trust_band,
    round_even((0.2e0 * price_score + 0.15e0 * stock_score + 0.05e0 * freshness_score) / (0.2e0 + 0.15e0 + 0.05e0), 6) AS secondary
  FROM (SELECT *, CASE WHEN price_toman IS NULL THEN 0e0 WHEN lo = hi THEN 1e0 ELSE (hi - price_toman) / CAST(hi - lo AS DOUBLE) END AS price_score,
      CASE stock_status WHEN 'in_stock' THEN 1e0 WHEN 'unknown' THEN 0.5e0 ELSE 0e0 END AS stock_score,
      pow(0.5e0, greatest(0e0, epoch(TIMESTAMP '{v.AS_OF}' - occurred_at) / 86400e0) / 7e0) AS freshness_score
    FROM (SELECT p.*, t.trust_score, min(price_toman) OVER (PARTITION BY product_uid) AS lo, max(price_toman) OVER (PARTITION BY product_uid) AS hi
      FROM price_state p JOIN seller_trust t USING (seller_key) WHERE p.is_active))""",
)
add_view(
    "ranked_offers",
    "scored_offers",
    """
  SELECT *, row_number() OVER (PARTITION BY product_uid ORDER BY trust_band DESC, secondary DESC, offer_uid) AS rank_position
    FROM scored_offers""",
)


def rankable(spark, d):
    """Active offers in the columns that their ranking reads; sellers meet them on their numbers."""
    trust = seller_trust(spark, d).select("supp_key", "trust_score")
    return v.price_state(spark, d, trust).where("is_active").select(
        "seller_key", F.col("occurred_at").alias("last_seen_at"), "product_uid", "offer_uid", "price_toman", "stock_status", "trust_score",
    )


def ranked(spark, d):
    offers = cut_lineage(rankable(spark, d))  # read for the bounds and for the ranks
    return ranking.rank_offers(offers, v.as_of())


@query(
    "rank_offers",
    "ranked_offers",
    """SELECT product_uid, offer_uid, seller_key, price_toman, stock_status, trust_band, rank_position, secondary FROM ranked_offers""",
)
def rank_offers(spark, d):
    return ranked(spark, d).select(
        "product_uid", "offer_uid", "seller_key", "price_toman", "stock_status", "trust_band",
        "rank_position", "secondary",
    )


@query(
    "price_score",
    "scored_offers",
    "SELECT offer_uid, round(price_score, 6) AS price_score FROM scored_offers",
)
def price_score(spark, d):
    return ranked(spark, d).select("offer_uid", F.bround("price_score", 6).alias("price_score"))


@query(
    "freshness_score",
    "price_state",
    """SELECT offer_uid, CAST(floor(1e6 * pow(0.5e0, greatest(0e0, epoch(TIMESTAMP '2001-10-01' - occurred_at) / 86400e0) / 7e0)) AS BIGINT) AS freshness_ppm
    FROM price_state""",
)
def freshness_score(spark, d):
    score = ranking.freshness_score(F.col("occurred_at"), v.as_of("2001-10-01"), 7.0)
    return v.price_state(spark, d).select("offer_uid", F.floor(score * 1e6).alias("freshness_ppm"))


@query(
    "trust_band",
    "seller_trust",
    """SELECT seller_key, CAST(floor(greatest(0e0, least(1e0, trust_score)) / 0.05e0 + 1e-9) AS BIGINT) AS trust_band FROM seller_trust""",
)
def trust_band(spark, d):
    t = seller_trust(spark, d)
    return t.select("seller_key", ranking.trust_band(F.col("trust_score"), 0.05).alias("trust_band"))


@query(
    "cheapest_badge",
    "ranked_offers",
    """
  SELECT product_uid, offer_uid AS cheapest_offer_uid, CAST(grade AS BIGINT) AS grade FROM (SELECT *, CASE WHEN stock_status = 'in_stock' AND price_toman IS NOT NULL THEN 0
    WHEN price_toman IS NOT NULL THEN 1 ELSE 2 END AS grade FROM ranked_offers)
  QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY grade, CASE WHEN grade < 2 THEN price_toman ELSE rank_position END, offer_uid) = 1""",
)
def cheapest_badge(spark, d):
    return pricing.cheapest_badge(ranked(spark, d))


@query(
    "latest_observation_per_key",
    "price_events",
    """SELECT source_key, external_key, event_id, price_toman FROM price_events
    QUALIFY row_number() OVER (PARTITION BY source_key, external_key ORDER BY occurred_at DESC, event_id DESC) = 1""",
)
def latest_observation_per_key(spark, d):
    ev = v.price_events(spark, d).select("source_key", "external_key", "event_id", "occurred_at", "price_toman")
    out = ranking.latest_per_key(ev, ["source_key", "external_key"], ["occurred_at", "event_id"])
    return out.drop("occurred_at")


@query(
    "seller_price_rank",
    "price_state",
    f"""
  SELECT p.product_uid, offer_uid, seller_key, price_toman,
    rank() OVER (PARTITION BY p.product_uid ORDER BY price_toman) AS price_rank, market_median, priced_offers
  FROM price_state p JOIN (SELECT product_uid, {MEDIAN.format("price_toman")} AS market_median, count(*) AS priced_offers
    FROM price_state WHERE price_toman IS NOT NULL AND is_active GROUP BY product_uid) m USING (product_uid)
  WHERE price_toman IS NOT NULL AND is_active""",
)
def seller_price_rank(spark, d):
    return ranking.seller_price_rank(v.price_state(spark, d).where("is_active"))


@query(
    "budget_admission",
    "",
    """
  WITH c AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(floor(value * 10) AS BIGINT) AS cost FROM events),
  s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM c)
  SELECT event_id AS call_id, CAST(spent_before AS BIGINT) AS spent_before, spent_before < 50000 AS admitted,
    spent_before < 50000 AND spent_before + cost >= 0.8 * 50000 AS warn FROM s""",
)
def budget_admission(spark, d):
    calls = v.table(spark, d, "events").select(
        F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("called_at"),
        F.floor(F.col("value") * 10).alias("cost"),
    )
    out = ranking.budget_admission(calls, 50_000)
    return out.select("call_id", "spent_before", "admitted", "warn")


@query(
    "median_by_group",
    "active_offers",
    """SELECT part_number, round(median(CAST(price_toman AS DOUBLE)), 6) AS median_price FROM active_offers
    WHERE part_number IS NOT NULL AND price_toman IS NOT NULL GROUP BY part_number""",
)
def median_by_group(spark, d):
    rows = v.offers(spark, d).where("is_active AND part_number IS NOT NULL AND price_toman IS NOT NULL")
    return rows.groupBy("part_number").agg(F.bround(F.median("price_toman"), 6).alias("median_price"))

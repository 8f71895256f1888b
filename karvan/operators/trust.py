"""Seller trust from what we observe ourselves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.operators import skew
from karvan.params import HOT_KEY_ROWS, NON_PANEL_TRUST_CAP, TrustParams


def smoothed_accuracy(hits: Column, seen: Column, prior: float, strength: float) -> Column:
    return F.when(seen <= 0, F.lit(prior)).otherwise(
        (hits + F.lit(prior * strength)) / (seen + F.lit(strength))
    )


def clamp01(value: Column) -> Column:
    """Null stays null: greatest() and least() alone would skip it."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def domain_age_score(days: Column, prior: float) -> Column:
    return F.when(days.isNull(), F.lit(prior)).otherwise(clamp01(days / 730.0))


def trust_observations(
    events: DataFrame,
    hot_rows: int = HOT_KEY_ROWS,
    offer: Sequence[str] = ("offer_uid",),
    describe: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per seller: how often the price we saw still held, and "in stock" too.

    The order of one offer's events matters only between neighbours, so the rest is
    a map-side-combined sum per seller. ``offer``: the columns that name an offer.
    ``describe`` writes the other columns where the events of an offer have met.
    """
    lagged = skew.lag_in_key(
        events,
        offer,
        ["occurred_at", "event_id"],
        {"prev_price": "price_toman", "prev_stock": "stock_status"},
        skew.day_chunk("occurred_at"),
        hot_rows,
        seen="seen_before",
        collapse_ties=True,
        describe=describe,
    )
    again = F.col("seen_before")
    priced = again & F.col("prev_price").isNotNull() & F.col("price_toman").isNotNull()
    stocked = again & (F.col("prev_stock") == "in_stock")
    return lagged.groupBy("seller_key").agg(
        F.count_if(priced).alias("price_observations"),
        F.count_if(priced & (F.col("prev_price") == F.col("price_toman"))).alias("price_hits"),
        F.count_if(stocked).alias("stock_observations"),
        F.count_if(stocked & (F.col("stock_status") == "in_stock")).alias("stock_hits"),
    )


def trust_score(sellers: DataFrame, p: TrustParams | None = None) -> DataFrame:
    """Score, tier and published accuracies.

    ``sellers`` holds the observation counts plus ``is_panel``, ``domain_age_days``,
    ``contact_completeness``, ``has_trust_badge``, ``tier`` and ``tier_override``.
    """
    p = p or TrustParams()
    price = smoothed_accuracy(F.col("price_hits"), F.col("price_observations"), p.prior, p.smoothing)
    stock = smoothed_accuracy(F.col("stock_hits"), F.col("stock_observations"), p.prior, p.smoothing)
    contact = F.coalesce(clamp01(F.col("contact_completeness")), F.lit(p.prior))
    badge = F.coalesce(F.col("has_trust_badge").cast("double"), F.lit(p.prior))
    weights = p.price_accuracy + p.stock_accuracy + p.panel + p.domain_age + p.contact + p.badge
    raw = (
        F.lit(p.price_accuracy) * price
        + F.lit(p.stock_accuracy) * stock
        + F.lit(p.panel) * F.col("is_panel").cast("double")
        + F.lit(p.domain_age) * domain_age_score(F.col("domain_age_days"), p.prior)
        + F.lit(p.contact) * contact
        + F.lit(p.badge) * badge
    ) / F.lit(weights)
    seen = F.least("price_observations", "stock_observations")
    tier = (
        F.when(F.col("tier_override").isNotNull(), F.col("tier_override"))
        .when(F.col("tier") == "suspended", "suspended")
        .when(seen < p.min_observations, "new")
        .when(
            (seen >= p.trusted_observations)
            & (price >= p.trusted_threshold)
            & (stock >= p.trusted_threshold),
            "trusted",
        )
        .otherwise("standard")
    )
    ceiling = F.element_at(
        F.create_map(*[F.lit(x) for pair in p.ceilings.items() for x in pair]), F.col("new_tier")
    )

    def published(value: Column, count: str) -> Column:
        return F.when(F.col(count) >= p.min_observations, F.bround(value, 4))

    return (
        sellers.withColumn("new_tier", tier)
        .withColumn("trust_score", F.bround(F.least(clamp01(raw), ceiling), 4))
        .withColumn("price_accuracy", published(price, "price_observations"))
        .withColumn("stock_accuracy", published(stock, "stock_observations"))
        .withColumn("tier", F.col("new_tier"))
        .drop("new_tier")
    )


def changed_sellers(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sellers whose score, tier or published accuracy moved."""
    cols = ["trust_score", "tier", "price_accuracy", "stock_accuracy"]
    before = previous.select("seller_key", *[F.col(c).alias(f"__{c}") for c in cols])
    moved = F.lit(False)
    for c in cols:
        a, b = F.col(c), F.col(f"__{c}")
        if c != "tier":
            a, b = F.bround(a, 6), F.bround(b, 6)
        moved = moved | ~a.eqNullSafe(b)
    return current.join(before, "seller_key", "left").where(moved).select(*current.columns)


def products_to_rebuild(changed: DataFrame, offers: DataFrame) -> DataFrame:
    """Products holding an offer of a changed seller."""
    return (
        offers.select("seller_key", "product_uid")
        .join(changed.select("seller_key"), "seller_key", "left_semi")
        .select("product_uid")
        .distinct()
    )


def seller_view_cap(trust: Column, is_panel: Column, cap: float = NON_PANEL_TRUST_CAP) -> Column:
    """What billing shows: non-panel sellers never look better than the cap."""
    return F.when(is_panel, trust).otherwise(F.least(trust, F.lit(cap)))


def seller_profile(offers: DataFrame) -> DataFrame:
    """Counts per seller over active offers (distinct products in two steps)."""
    active = offers.where("is_active")
    return (
        active.groupBy("seller_key", "product_uid")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stock_status") == "in_stock").alias("s"))
        .groupBy("seller_key")
        .agg(
            F.sum("n").alias("active_offers"),
            F.sum("s").alias("in_stock_offers"),
            F.count(F.lit(1)).alias("active_products"),
        )
    )

"""Price statistics, the cheapest badge and the daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_half_up(value: Column) -> Column:
    """Integer median, half up. ``percentile`` keeps value counts and combines
    map-side, so no group's rows are ever gathered in one place."""
    return F.floor(F.percentile(value, 0.5) + 0.5).cast("long")


def counts_for_headline() -> Column:
    return (F.col("stock_status") == "in_stock") & F.col("price_toman").isNotNull()


def price_stats(offers: DataFrame, key: str = "product_uid") -> DataFrame:
    """min / max / median over in-stock priced offers; nulls when there are none."""
    price = F.when(counts_for_headline(), F.col("price_toman"))
    return offers.groupBy(key).agg(
        F.min(price).alias("min_price_toman"),
        F.max(price).alias("max_price_toman"),
        median_half_up(price).alias("median_price_toman"),
    )


def cheapest_badge(ranked: DataFrame, key: str = "product_uid") -> DataFrame:
    """One offer per product: cheapest in stock, else cheapest priced, else top ranked."""
    grade = F.when(counts_for_headline(), 0).when(F.col("price_toman").isNotNull(), 1).otherwise(2)
    choice = F.struct(
        grade.alias("grade"),
        F.coalesce("price_toman", F.col("rank_position").cast("long")).alias("by"),
        F.col("offer_uid").alias("offer_uid"),
    )
    return ranked.groupBy(key).agg(F.min(choice).alias("c")).select(
        key, F.col("c.offer_uid").alias("cheapest_offer_uid"), F.col("c.grade").alias("grade")
    )


def price_history_scope(points: DataFrame, members: DataFrame) -> DataFrame:
    """Points of current members or tagged with the product: union of two equi-joins."""
    cols = ["product_uid", "offer_uid", "observed_at", "price_toman", "stock_status"]
    by_member = points.drop("product_uid").join(members.select("product_uid", "offer_uid"), "offer_uid")
    tagged = points.where(F.col("product_uid").isNotNull())
    return by_member.select(*cols).unionByName(tagged.select(*cols)).distinct()


def daily_price_series(points: DataFrame, start: str, end: str, offer: Sequence[str] = ("offer_uid",)) -> DataFrame:
    """min and median of in-stock offers per product and day, last state carried on.

    ``offer``: the columns that name an offer.

    Everything before the window folds into one seed row per offer, so an offer
    holds at most one row per day of the window before the calendar expansion, and
    the expansion is reduced map-side to (product, day).
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    day = F.to_date("observed_at")
    slot = F.when(day < first, F.date_sub(first, 1)).otherwise(day)
    states = (
        points.where(day <= last)
        .groupBy("product_uid", *offer, slot.alias("day"))
        .agg(F.max_by(F.struct("price_toman", "stock_status"), "observed_at").alias("s"))
    )
    window = Window.partitionBy("product_uid", *offer).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(window), 1), last)
    spans = (
        states.withColumn("until", until)
        .withColumn("since", F.greatest("day", first))
        .where((F.col("s.stock_status") == "in_stock") & F.col("s.price_toman").isNotNull())
        .where(F.col("since") <= F.col("until"))
    )
    return (
        spans.select(
            "product_uid",
            F.col("s.price_toman").alias("price_toman"),
            F.explode(F.sequence("since", "until")).alias("date"),
        )
        .groupBy("product_uid", "date")
        .agg(
            F.min("price_toman").alias("min_toman"),
            median_half_up(F.col("price_toman")).alias("median_toman"),
        )
    )

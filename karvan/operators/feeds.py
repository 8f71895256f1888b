"""Public feeds: sitemap shards, landing hubs, structured-data aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.operators import skew
from karvan.operators.pricing import counts_for_headline
from karvan.params import HOT_KEY_ROWS


def aggregate_offer_view(offers: DataFrame, currency: str = "IRT") -> DataFrame:
    price = F.when(counts_for_headline(), F.col("price_toman"))
    return offers.groupBy("product_uid").agg(
        F.min(price).alias("low_price"),
        F.max(price).alias("high_price"),
        F.lit(currency).alias("currency"),
        F.count(F.lit(1)).alias("offer_count"),
    )


def sitemap_shards(
    products: DataFrame, shard_size: int = 50_000, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Published, live products by (priority desc, uid), cut into numbered shards.

    The whole table is one ordered group, so past ``hot_rows`` products it is cut by
    priority and the first characters of the uid, which follow the order.
    """
    live = products.where("is_published AND NOT is_retired").withColumn("__all", F.lit(1))
    lead = [F.ascii(F.substring("product_uid", i, 1)) for i in (1, 2, 3)]
    prefix = lead[0] * 65536 + lead[1] * 256 + lead[2]
    chunk = -F.col("priority").cast("long") * (1 << 24) + prefix
    order = [F.desc("priority"), F.asc("product_uid")]
    placed = skew.ordinal_in_key(live, ["__all"], order, "position", chunk, hot_rows)
    return placed.select(
        "product_uid", "slug", "lastmod", "position",
        F.floor((F.col("position") - 1) / shard_size).alias("shard"),
    )


def landing_hubs(products: DataFrame) -> DataFrame:
    """Counts and lowest price per vehicle, per part type and per pair."""
    rows = products.where("is_published").select(
        F.explode_outer("vehicles").alias("vehicle"), "part_type", "product_uid", "offer_count", "min_price_toman"
    )
    measures = [
        F.count(F.lit(1)).alias("products"),
        F.sum("offer_count").alias("offers"),
        F.min("min_price_toman").alias("min_price_toman"),
    ]
    pairs = rows.where("vehicle IS NOT NULL AND part_type IS NOT NULL")
    by_vehicle = rows.where("vehicle IS NOT NULL").groupBy("vehicle").agg(*measures)
    by_pair = pairs.groupBy("vehicle", "part_type").agg(*measures)
    by_type = (
        products.where("is_published AND part_type IS NOT NULL").groupBy("part_type").agg(*measures)
    )
    return (
        by_pair.unionByName(by_vehicle.withColumn("part_type", F.lit(None).cast("string")))
        .unionByName(by_type.withColumn("vehicle", F.lit(None).cast("string")))
    )

"""Crawl planning: tiers, adapter health, archive bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alert when the parse rate falls below this share of the baseline (fixed value).
HEALTH_RATIO = 0.80


def crawl_tiers(
    observations: DataFrame, signals: DataFrame, now: Column,
    key: Sequence[str] = ("source", "external_key"), written: dict[str, Column] | None = None,
) -> DataFrame:
    """(source, url, tier): hot, warm, dormant, cold.

    ``observations``: source, external_key, offer_uid, url, raw_price_text,
    observed_at, last_seen_at, id. A url may be hot and warm; cold excludes both by url.
    ``written`` names columns that follow from the ``key``: they are only spelled for the page that
    stays, so observations need not carry them.
    """
    written = written or {}
    week, month = now - F.make_interval(days=F.lit(7)), now - F.make_interval(days=F.lit(30))
    state = [c for c in ("source", "offer_uid", "url", "last_seen_at") if c not in (*key, *written)]
    recent = F.when(F.col("observed_at") >= week, F.col("raw_price_text"))
    pages = observations.groupBy(*key).agg(
        F.max_by(F.struct(*state), "id").alias("o"), F.min(recent).alias("lo"), F.max(recent).alias("hi")
    )
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    off = F.lit(False)
    marked = pages.select(
        *key, "o.*",
        F.coalesce(known & (F.col("lo") < F.col("hi")), off).alias("changed"),
        F.coalesce(F.col("o.last_seen_at") >= month, off).alias("seen"),
        F.coalesce(F.col("o.last_seen_at") < month, off).alias("dormant"),
    ).drop("last_seen_at")
    clicked = signals.where((F.col("count_7d") > 0) & (F.col("updated_at") >= week)).select("offer_uid").distinct()
    named = marked.withColumns({c: e for c, e in written.items() if c == "offer_uid"})
    met = named.join(clicked.withColumn("hot", F.lit(True)), "offer_uid", "left").withColumns(
        {c: e for c, e in written.items() if c != "offer_uid"}
    )
    hot, warm = F.coalesce("hot", off), F.col("changed") & F.col("seen")
    # One row per url: how many of its pages are in each tier, and whether one of them is busy.
    urls = met.groupBy("source", "url").agg(
        F.count_if(hot).alias("hot"), F.count_if(warm).alias("warm"), F.count_if("seen").alias("seen"),
        F.count_if("dormant").alias("dormant"), F.max(hot | warm).alias("busy"),
    )
    barred = F.col("busy") & F.col("source").isNotNull() & F.col("url").isNotNull()
    tiers = {"hot": F.col("hot"), "warm": F.col("warm"), "cold": F.when(barred, 0).otherwise(F.col("seen")), "dormant": F.col("dormant")}
    each = F.flatten(F.array(*[F.array_repeat(F.lit(t), n.cast("int")) for t, n in tiers.items()]))
    return urls.select("source", "url", F.explode(each).alias("tier"))


def adapter_health(runs: DataFrame) -> DataFrame:
    """Parse rate against the average of the seven days before, current run excluded.

    ``runs``: source, measured_at, attempted, parsed_ok. One row per crawl run, so a
    source holds few rows; the frame is a RANGE in seconds.
    """
    secs = F.unix_timestamp("measured_at")
    rate = F.when(F.col("attempted") > 0, F.col("parsed_ok") / F.col("attempted")).otherwise(F.lit(0.0))
    frame = Window.partitionBy("source").orderBy("__s").rangeBetween(-7 * 86400, -1)
    counted = F.when(F.col("attempted") > 0, F.col("parse_rate"))
    rows = runs.withColumn("__s", secs).withColumn("parse_rate", rate)
    return (
        rows.withColumn("baseline_rate", F.avg(counted).over(frame))
        .withColumn("alerted", F.coalesce(F.col("parse_rate") < F.col("baseline_rate") * HEALTH_RATIO, F.lit(False)))
        .drop("__s")
    )


def adapter_broken_reviews(health: DataFrame) -> DataFrame:
    """One review per source and UTC day: the first alert of the day."""
    alerts = health.where("alerted").withColumn("day", F.to_date("measured_at"))
    first = alerts.groupBy("source", "day").agg(
        F.min_by(F.struct("attempted", "parsed_ok", "parse_rate", "baseline_rate"), "measured_at").alias("e")
    )
    return first.select(
        F.concat_ws(":", F.lit("adapter-broken"), "source", F.col("day").cast("string")).alias("request_uid"),
        "source", F.col("day").cast("string").alias("day"), "e.*",
    )


def archive_dedupe(fetches: DataFrame, content: str = "content") -> DataFrame:
    """One archive object per (source, url, content): seen times and the object path."""
    hashed = fetches.withColumn("page_hash", F.sha2(content, 256)).withColumn("url_hash", F.sha2("url", 256))
    objects = hashed.groupBy("source", "url_hash", "page_hash").agg(
        F.min("url").alias("url"),
        F.min("fetched_at").alias("fetched_at"),
        F.max("fetched_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("seen_count"),
    )
    day = F.date_format("fetched_at", "yyyy/MM/dd")
    return objects.withColumn("path", F.concat_ws("/", "source", day, F.concat("page_hash", F.lit(".gz"))))


def archive_retention(objects: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Objects to prune: old and superseded by a newer one of the same url."""
    newest = objects.groupBy("source", "url_hash").agg(F.max("fetched_at").alias("newest"))
    old = F.col("fetched_at") < now - F.make_interval(days=F.lit(days))
    return objects.join(newest, ["source", "url_hash"]).where(old & (F.col("fetched_at") < F.col("newest"))).drop("newest")


def replay_range(observations: DataFrame, source: str, since: Column, until: Column) -> DataFrame:
    """Archived observations of a source in a time range, in id order inside each file.

    The filters reach the scan; original times and hashes are kept as they are.
    """
    rows = observations.where(
        (F.col("source") == source) & (F.col("observed_at") >= since) & (F.col("observed_at") <= until)
    )
    return rows.repartitionByRange("observed_at", "id").sortWithinPartitions("observed_at", "id")

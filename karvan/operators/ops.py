"""Review queue, review contract and pipeline health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys a decision's subject must carry, per kind (fixed values).
SUBJECT_KEYS = {
    "merge_pair": ("offer_uid_a", "offer_uid_b", "cluster_uid"),
    "split_product": ("cluster_uid", "offer_uids", "successor_uid"),
    "fitment_conflict": ("part_number", "vehicle_slug", "status"),
    "synonym_candidate": ("token", "part_type"),
    "price_ambiguous": ("offer_uid", "source_key", "external_key"),
    "adapter_broken": ("source_key", "adapter_key"),
}
#: Consumer lag that raises the alarm (fixed value).
LAG_ALARM = 50_000


def review_queue(requested: DataFrame, decided: DataFrame) -> DataFrame:
    """Open reviews by priority: each request once, skips stay open."""
    latest = requested.groupBy("request_uid").agg(
        F.max_by(F.struct("kind", "priority", "requested_at"), F.struct("requested_at", "priority")).alias("r")
    ).select("request_uid", "r.*")
    final = decided.groupBy("request_uid").agg(F.max_by("decision", "decided_at").alias("decision"))
    closed = final.where("decision <> 'skip'").select("request_uid")
    return latest.join(closed, "request_uid", "left_anti").orderBy(F.desc("priority"), "requested_at", "request_uid")


def review_kind_contract(decisions: DataFrame) -> DataFrame:
    """Missing subject keys per decision (``subject`` is JSON); unknown kinds pass."""
    missing = F.array().cast("array<string>")
    for kind, keys in SUBJECT_KEYS.items():
        absent = F.filter(
            F.array(*[F.when(F.get_json_object("subject", f"$.{k}").isNull(), k) for k in keys]),
            lambda k: k.isNotNull(),
        )
        missing = F.when(F.col("kind") == kind, absent).otherwise(missing)
    return decisions.withColumn("missing_keys", missing).withColumn("is_valid", F.size("missing_keys") == 0)


def pipeline_health(
    events: DataFrame, dead_letters: DataFrame, lags: DataFrame, dlq_alarm: float = 0.01, lag_alarm: int = LAG_ALARM
) -> DataFrame:
    """Per topic and hour: volume, redeliveries, late rows, dead-letter rate, consumer lag.

    ``events``: topic, event_id, occurred_at, is_late. ``dead_letters``: topic, failed_at.
    ``lags``: topic, consumer_group, measured_at, lag. A group raises the alarm when its lag
    stays above ``lag_alarm`` for a whole quarter of an hour; volume alone never does.
    Redeliveries come from a per-id count, so no distinct over the whole hour is needed.
    """
    hour = F.date_trunc("hour", "occurred_at")
    per_id = events.groupBy("topic", hour.alias("hour"), "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_late").alias("late")
    )
    volume = per_id.groupBy("topic", "hour").agg(
        F.sum("n").alias("messages"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("late").alias("late")
    )
    dead = dead_letters.groupBy("topic", F.date_trunc("hour", "failed_at").alias("hour")).agg(F.count(F.lit(1)).alias("dead"))
    quarter = F.window("measured_at", "15 minutes")["start"].alias("quarter")
    least = lags.groupBy("topic", "consumer_group", quarter).agg(F.min("lag").alias("lag"))
    lag = least.groupBy("topic", F.date_trunc("hour", "quarter").alias("hour")).agg(F.max("lag").alias("held_lag"))
    share = F.coalesce("dead", F.lit(0)) / F.col("messages")
    return (
        volume.join(dead, ["topic", "hour"], "left")
        .join(lag, ["topic", "hour"], "left")
        .withColumn("held_lag", F.coalesce("held_lag", F.lit(0).cast("long")))
        .withColumn("dead", F.coalesce("dead", F.lit(0)))
        .withColumn("dead_rate", share)
        .withColumn("alarm", (F.col("dead_rate") > dlq_alarm) | (F.col("held_lag") > lag_alarm))
    )

"""Review queue, contracts and pipeline health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import ops
from karvan.plans import views as v
from karvan.plans.registry import query


def requested(spark, d):
    """A request per signup, sent twice; priority is the value."""
    e = v.table(spark, d, "events").where("event_type = 'signup'")
    base = e.select(
        F.concat(F.lit("r"), "event_id").alias("request_uid"), F.lit("merge_pair").alias("kind"), F.floor("value").cast("long").alias("priority"),
        F.col("ts").cast("timestamp").alias("requested_at"), "event_id",
    )
    return base.unionByName(base)


@query(
    "review_queue",
    "",
    "SELECT 'r' || event_id AS request_uid, CAST(floor(value) AS BIGINT) AS priority FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0",
)
def review_queue(spark, d):
    """id%3=0 is decided; id%3=1 was skipped and stays open."""
    r = requested(spark, d)
    decided = r.where("event_id % 3 <> 2").select("request_uid", F.when(F.col("event_id") % 3 == 0, "same").otherwise("skip").alias("decision"), F.col("requested_at").alias("decided_at"))
    return ops.review_queue(r, decided).select("request_uid", "priority")


@query(
    "review_kind_contract",
    "",
    """
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'status' WHEN 2 THEN 'part_type' ELSE '' END AS missing_keys, event_id % 4 IN (0, 3) AS is_valid FROM events""",
)
def review_kind_contract(spark, d):
    i = F.col("event_id") % 4
    subject = F.when(
        i == 0, F.to_json(F.struct(F.lit("PN1").alias("part_number"), F.lit("v").alias("vehicle_slug"), F.lit("unknown").alias("status")))
    ).when(i == 1, F.to_json(F.struct(F.lit("PN1").alias("part_number"), F.lit("v").alias("vehicle_slug")))).when(i == 2, F.lit('{"token": "x"}')).otherwise(F.lit("{}"))
    kind = F.when(i < 2, "fitment_conflict").when(i == 2, "synonym_candidate").otherwise("something_new")
    rows = v.table(spark, d, "events").select("event_id", kind.alias("kind"), subject.alias("subject"))
    out = ops.review_kind_contract(rows)
    return out.select("event_id", F.array_join("missing_keys", ",").alias("missing_keys"), "is_valid")


@query(
    "pipeline_health",
    "",
    """
  WITH e AS (SELECT event_type AS topic, date_trunc('hour', ts) AS h, event_id FROM events),
  s AS (SELECT topic, h, count(*) + count(*) FILTER (WHERE event_id % 10 = 0) AS messages, count(*) FILTER (WHERE event_id % 10 = 0) AS duplicates,
    count(*) FILTER (WHERE event_id % 20 = 3) AS late, count(*) FILTER (WHERE event_id % 50 = 1) AS dead FROM e GROUP BY ALL),
  l AS (SELECT topic, h, max(least_lag) AS held_lag FROM (SELECT event_type AS topic, date_trunc('hour', ts) AS h, floor(minute(ts) / 15) AS q,
      event_id % 2 AS g, min(CAST(floor(value * 1000) AS BIGINT)) AS least_lag FROM events GROUP BY ALL) GROUP BY ALL)
  SELECT topic, CAST(epoch(h) AS BIGINT) AS hour, messages, duplicates, late, dead, held_lag, dead / messages > 0.01 OR held_lag > 50000 AS alarm
  FROM s JOIN l USING (topic, h)""",
)
def pipeline_health(spark, d):
    e = v.table(spark, d, "events").select(
        F.col("event_type").alias("topic"), "event_id", F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("event_id") % 20 == 3).alias("is_late")
    )
    seen = e.unionByName(e.where("event_id % 10 = 0"))
    dead = e.where("event_id % 50 = 1").select("topic", F.col("occurred_at").alias("failed_at"))
    lags = v.table(spark, d, "events").select(
        F.col("event_type").alias("topic"), (F.col("event_id") % 2).alias("consumer_group"), F.col("ts").cast("timestamp").alias("measured_at"),
        F.floor(F.col("value") * 1000).cast("long").alias("lag"),
    )
    out = ops.pipeline_health(seen, dead, lags)
    return out.select("topic", F.unix_timestamp("hour").alias("hour"), "messages", "duplicates", "late", "dead", "held_lag", "alarm")

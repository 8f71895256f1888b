"""Structured Streaming entries. Each runs the same rules as its batch twin, and a
full batch rebuild must give the same table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from karvan.operators import cdc


STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Drain what is there in micro-batches, then stop. Restarting resumes.

    State lies in RocksDB on the executors' disks, so it is not bounded by their memory.
    """
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_CONF}
    for k, value in STATE_CONF.items():
        conf.set(k, value)
    try:  # a query takes its own copy of the settings when it starts
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for k, value in before.items():
            conf.unset(k) if value is None else conf.set(k, value)
    query.awaitTermination()


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that owns one folder per batch id: a retried batch replaces its own output."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch_id BIGINT").option("basePath", path).parquet(path)


def dedupe_table(path: str, keys: list[str], schema: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the first delivery of each key, however late an event is.

    A batch is compared with the keys of all earlier batches; a retried batch replaces its own
    output. The keys are read again for each batch, so its cost grows with the table.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.dropDuplicates(keys)
        if batch_id > 0:
            kept = read_batches(df.sparkSession, path, schema).where(F.col("batch_id") < batch_id)
            known = kept.select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            rows = rows.join(known, same, "left_anti")
        batch_table(path)(rows, batch_id)

    return write


def latest_state_stream(events: DataFrame, keys: list[str], time: str = "occurred_at", tie: str = "event_id") -> DataFrame:
    """Newest row per key as a running aggregate (output mode update).

    An older event loses against the state whenever it arrives, so no order is assumed.
    """
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(time, tie)).alias("row"), F.count(F.lit(1)).alias("seen")
    )


def upsert_table(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The current table behind an update-mode stream: last batch per key."""
    rows = read_batches(spark, path, schema)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def anchored_counter_stream(clicks: DataFrame, keys: list[str], ttl_seconds: int, limit: int) -> DataFrame:
    """Flag clicks past ``limit`` in the window the key's first click opened.

    State is two numbers per key and expires with the event-time watermark.
    ``clicks`` needs a watermark on ``occurred_at``.
    """
    ttl = ttl_seconds * 1_000_000
    out = "click_id long, window_count long, flagged boolean"

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["us", "click_id"])
        counts = []
        for us in rows["us"]:
            if start is None or us >= start + ttl:
                start, count = int(us), 0
            count += 1
            counts.append(count)
        state.update((start, count))
        state.setTimeoutTimestamp(max(start + ttl, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        yield pd.DataFrame(
            {"click_id": rows["click_id"].to_numpy(), "window_count": counts, "flagged": [c > limit for c in counts]}
        )

    slim = clicks.select(*keys, "click_id", "occurred_at", F.unix_micros("occurred_at").alias("us"))
    return slim.groupBy(*keys).applyInPandasWithState(
        step, out, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout
    )


def click_counters_stream(clicks: DataFrame) -> DataFrame:
    """Running totals per (product, offer), output mode update."""
    return clicks.groupBy("product_uid", "offer_uid").agg(
        F.count(F.lit(1)).alias("clicks"), F.max("occurred_at").alias("last_click_at")
    )


def click_signal_stream(clicks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Clicks per offer in 7-day windows sliding by a day."""
    return (
        clicks.withWatermark("occurred_at", delay)
        .groupBy(F.window("occurred_at", "7 days", "1 day"), "offer_uid")
        .agg(F.count(F.lit(1)).alias("count_7d"))
    )


def refresh_affected(
    touched_keys: Callable[[DataFrame], DataFrame],
    recompute: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: which products does this batch touch, recompute only those."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write(recompute(touched_keys(batch).distinct()), batch_id)

    return handle


def late_rows(events: DataFrame, state: DataFrame, keys: list[str], time: str = "occurred_at") -> DataFrame:
    """Rows that lost against newer state: dropped by the policy, counted by this."""
    known = state.select(*keys, F.col(time).alias("__at"))
    return events.join(known, keys).where(F.col(time) < F.col("__at")).drop("__at")


def merge_batch(state: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """State after a batch: the newer of both per key. Replays change nothing."""
    both = batch if state is None else state.unionByName(batch)
    return cdc.latest_state(both, keys)

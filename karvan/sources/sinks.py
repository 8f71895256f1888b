"""Table and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_history_sink(points: DataFrame, path: str) -> None:
    """Month-partitioned history; only the months present are replaced.

    ``rebalance`` lets AQE split a month that is too big for one writer and merge small
    ones, so file sizes stay even.
    """
    monthly = points.withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    (
        monthly.hint("rebalance", "month")
        .sortWithinPartitions("month", "offer_uid", "observed_at")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("month").parquet(path)
    )


def csv_report_sink(report: DataFrame, path: str) -> None:
    """A small aggregated report as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

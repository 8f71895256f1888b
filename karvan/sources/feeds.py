"""CSV and XML product feeds as listing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan.functions.text import urljoin

COLUMNS = ("id", "title", "link", "price", "availability", "image_link")


def _listings(rows: DataFrame, base: str, fragment) -> DataFrame:
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    keep = filled("id").isNotNull() & filled("title").isNotNull() & filled("link").isNotNull()
    return rows.where(keep).select(
        F.col("id").cast("string").alias("external_key"),
        urljoin(F.lit(base), F.col("link")).alias("url"),
        F.col("title").alias("raw_title"),
        F.col("price").cast("string").alias("raw_price_text"),
        F.col("availability").alias("raw_stock_text"),
        urljoin(F.lit(base), filled("image_link")).alias("image_url"),
        fragment.alias("raw_fragment"),
    )


def read_csv_feed(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Rows without id, title or link are dropped; no schema inference."""
    schema = ", ".join(f"{c} STRING" for c in COLUMNS)
    rows = (
        spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
        .option("multiLine", False).option("escape", '"').csv(path)
    )
    fragment = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit(""))) for c in COLUMNS])
    return _listings(rows, base, fragment)


def read_xml_feed(spark: SparkSession, path: str, base: str) -> DataFrame:
    """``<item>`` elements; namespace prefixes of the tags are ignored by the reader."""
    schema = ", ".join(f"{c} STRING" for c in COLUMNS)
    rows = (
        spark.read.format("xml").schema(schema).option("rowTag", "item")
        .option("ignoreNamespace", True).load(path)
    )
    return _listings(rows, base, F.to_json(F.struct(*COLUMNS)))

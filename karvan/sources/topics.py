"""Topic messages in and out: typed reading, contract split, dead letters, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karvan import schemas
from karvan.params import DEAD_LETTER_RAW_CHARS


def read_topic(messages: DataFrame, topic: str) -> DataFrame:
    """Raw (key, value) messages -> typed rows. Works on batch and stream alike.

    Unknown JSON fields are dropped, missing ones are null; a null payload is a
    tombstone; a value that is no JSON object at all has ``is_corrupt``. A message is parsed once:
    filters on the parsed columns stay above the ``explode`` instead of parsing it again each.
    """
    text = F.col("value").cast("string")
    parsed = F.from_json(text, schemas.envelope(topic))
    rows = messages.select(F.col("key").cast("string").alias("key"), text.alias("raw"), F.explode(F.array(parsed)).alias("m"))
    return rows.select(
        "key", "raw", "m.*",
        F.col("m.event_id").isNull().alias("is_corrupt"),
        (F.col("m.event_id").isNotNull() & F.col("m.payload").isNull()).alias("is_tombstone"),
    )


def topic_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """(key, value) from a folder of JSON-lines files as a stream."""
    schema = "key STRING, value STRING"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    """Options for ``readStream.format("kafka")`` where the connector is installed."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}


def contract_violations(rules: list[tuple[str, Column]]) -> Column:
    """Array of names of the rules a row breaks; a null test counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return F.filter(F.array(*broken), lambda r: r.isNotNull())


def contract_split(rows: DataFrame, rules: list[tuple[str, Column]], topic: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with reason, the start of the raw message for display, and all of it)."""
    checked = rows.withColumn("violations", contract_violations(rules))
    good = checked.where(F.size("violations") == 0).drop("violations")
    dead = checked.where(F.size("violations") > 0).select(
        F.lit(topic).alias("topic"), F.array_join("violations", ",").alias("reason"),
        F.substring(raw, 1, DEAD_LETTER_RAW_CHARS).alias("raw"), F.col(raw).alias("message"),
    )
    return good, dead


def offer_rules() -> list[tuple[str, Column]]:
    """Contract of an enriched offer."""
    c = F.col
    return [
        ("offer_uid", c("offer_uid").rlike("^[0-9a-f]{32}$")),
        ("price_toman", c("price_toman").isNull() | (c("price_toman") > 0)),
        ("stock_status", c("stock_status").isin(*schemas.STOCK)),
        ("authenticity_claim", c("authenticity_claim").isin(*schemas.AUTHENTICITY)),
        ("part_number", c("part_number").isNull() | c("part_number").rlike("^[A-Z0-9]+$")),
        ("pack_quantity", c("pack_quantity") >= 1),
    ]


def dlq_retry(dead: DataFrame, handled: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Parse dead letters of a topic again: (events to retry, letters that still cannot be read).

    Events handled meanwhile are dropped. Letters without a readable event are never lost.
    """
    again = dead.where(F.col("topic") == topic).select(F.lit(None).cast("string").alias("key"), F.col("message").alias("value"))
    rows = read_topic(again, topic)
    unreadable = F.col("is_corrupt") | F.col("event_id").isNull()
    retried = rows.where(~unreadable).dropDuplicates(["event_id"]).join(handled.select("event_id"), "event_id", "left_anti")
    return retried, rows.where(unreadable)


def emit_reference(vehicles: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """Snapshot of both reference tables as (topic, key, value) rows."""
    v = vehicles.select(F.lit("vehicles.changed").alias("topic"), F.col("vehicle_slug").alias("key"), F.to_json(F.struct(*sorted(vehicles.columns))).alias("value"))
    c = crossrefs.select(F.lit("crossrefs.changed").alias("topic"), F.concat_ws("|", "code_a", "code_b").alias("key"), F.to_json(F.struct(*sorted(crossrefs.columns))).alias("value"))
    return v.unionByName(c)


def write_changed(current: DataFrame, published: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows to publish: new keys and keys whose fingerprint moved.

    ``published`` (key, fingerprint) is what went out before. Applying the result twice
    publishes nothing the second time.
    """
    before = published.select(key, F.col(fingerprint).alias("__old"))
    return current.join(before, key, "left").where(~F.col(fingerprint).eqNullSafe(F.col("__old"))).drop("__old")


def seed_upsert(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Idempotent load: every key with ``action`` insert / update / unchanged / kept."""
    cols = [c for c in seed.columns if c != key]
    old = table.select(key, F.struct(*cols).alias("__old"))
    new = seed.select(key, F.struct(*cols).alias("__new"))
    o, n = F.col("__old"), F.col("__new")
    action = F.when(n.isNull(), "kept").when(o.isNull(), "insert").when(o.eqNullSafe(n), "unchanged").otherwise("update")
    joined = old.join(new, key, "full_outer").withColumn("action", action)
    return joined.withColumn("__row", F.coalesce("__new", "__old")).select(key, "__row.*", "action")

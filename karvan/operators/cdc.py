"""Change capture: deduplication, latest state, change points, debounce."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.functions.ids import canonical_hash
from karvan.operators import skew
from karvan.params import DEBOUNCE_SECONDS, FRAGMENT_MAX_BYTES, HOT_KEY_ROWS


def exact_dedupe(df: DataFrame, keys: Sequence[str] = ("topic", "event_id")) -> DataFrame:
    """Drop redeliveries of the same event."""
    return df.dropDuplicates(list(keys))


def latest_state(
    df: DataFrame, keys: Sequence[str], time: str = "occurred_at", tie: str | Column = "event_id"
) -> DataFrame:
    """Newest row per key; equal times go to the greatest ``tie``.

    ``max_by`` combines map-side, so a hot key never meets in one task unreduced.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def compact_with_tombstones(
    df: DataFrame, keys: Sequence[str], payload: str, time: str = "occurred_at", tie: str = "event_id"
) -> DataFrame:
    """Latest row per key with ``is_deleted`` where the latest payload is null."""
    return latest_state(df, keys, time, tie).withColumn("is_deleted", F.col(payload).isNull())


def cdc_fragment(
    df: DataFrame,
    keys: Sequence[str],
    fragment_hash: str,
    time: str,
    tie: str,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """One row per run of equal fragments: ``observed_at`` to ``last_seen_at``.

    A change row already knows when the run before it was last seen (its own
    lag), so runs need no running sum: the end of run i sits in change row i+1.
    """
    keys = list(keys)
    chunk = skew.day_chunk(time)
    hot = skew.find_hot(df, keys, hot_rows)
    lagged = skew.lag_in_key(
        df, keys, [time, tie], {"__hash": fragment_hash, "__seen_at": time}, chunk, seen="__any", hot=hot
    )
    changes = lagged.where(~F.col("__any") | ~F.col("__hash").eqNullSafe(F.col(fragment_hash)))
    ends = df.groupBy(*keys).agg(F.max(time).alias("__final"))
    following = skew.chunk_window(keys, hot).orderBy(F.col(time), F.col(tie))
    chunked = skew.with_chunks(changes, keys, chunk, hot)
    nxt = chunked.withColumn("__end", F.lead("__seen_at").over(following))
    if hot is not None:
        heads = (
            chunked.where(F.col(skew.CHUNK).isNotNull())
            .groupBy(*keys, skew.CHUNK)
            .agg(F.min_by("__seen_at", F.struct(time, tie)).alias("__head"))
        )
        carry = heads.select(
            *keys,
            skew.CHUNK,
            F.lead("__head").over(Window.partitionBy(*keys).orderBy(skew.CHUNK)).alias("__carry"),
        )
        nxt = nxt.join(carry, [*keys, skew.CHUNK], "left").withColumn("__end", F.coalesce("__end", "__carry"))
    return (
        nxt.join(ends, keys)
        .withColumn("last_seen_at", F.coalesce("__end", "__final"))
        .select(*df.columns, "last_seen_at")
    )


def fragment_cap(text: Column, max_bytes: int = FRAGMENT_MAX_BYTES) -> Column:
    """Cut to at most ``max_bytes`` bytes without leaving half a character."""
    raw = F.encode(text, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.coalesce(*cuts))


def material_change(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    time: str = "occurred_at",
    tie: str = "event_id",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Rows whose ``columns`` differ from the key's row before; the first is kept."""
    hashed = df.withColumn("state_hash", canonical_hash(columns))
    lagged = skew.lag_in_key(
        hashed, keys, [time, tie], {"__h": "state_hash"}, skew.day_chunk(time), hot_rows
    )
    return lagged.where(~F.col("__h").eqNullSafe(F.col("state_hash"))).drop("__h")


def price_change_points(
    df: DataFrame,
    hot_rows: int = HOT_KEY_ROWS,
    offer: Sequence[str] = ("offer_uid",),
    describe: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(price, stock) points that differ from the previous one, unique per time.

    ``offer``: the columns that name an offer. ``describe`` writes the other columns where the
    events of an offer have met.
    """
    lagged = skew.lag_in_key(
        df,
        offer,
        ["occurred_at", "event_id"],
        {"__p": "price_toman", "__s": "stock_status"},
        skew.day_chunk("occurred_at"),
        hot_rows,
        seen="__any",
        collapse_ties=True,
        describe=describe,
    )
    same = F.col("__p").eqNullSafe(F.col("price_toman")) & F.col("__s").eqNullSafe(
        F.col("stock_status")
    )
    return lagged.where(~F.col("__any") | ~same).select(
        *offer,
        *[c for c in ("product_uid",) if c in lagged.columns],
        F.col("occurred_at").alias("observed_at"),
        "price_toman",
        "stock_status",
    )


def keep_old_timestamp(new: DataFrame, old: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fingerprint a rebuild; where nothing moved, keep the published ``updated_at``."""
    fresh = new.withColumn("document_hash", canonical_hash(columns))
    before = old.select(
        key,
        F.col("document_hash").alias("__old_hash"),
        F.col("updated_at").alias("__old_at"),
    )
    joined = fresh.join(before, key, "left")
    changed = ~F.col("document_hash").eqNullSafe(F.col("__old_hash"))
    return (
        joined.withColumn("changed", changed)
        .withColumn("updated_at", F.when(changed, F.col("updated_at")).otherwise(F.col("__old_at")))
        .drop("__old_hash", "__old_at")
    )


def debounced_emission(
    changes: DataFrame,
    key: str,
    content_hash: str,
    time: str = "occurred_at",
    tie: str = "event_id",
    quiet_seconds: int = DEBOUNCE_SECONDS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """One emission per anchored window, none where the content went back.

    ``changes`` holds a key's content hash each time it moved. The window opens at
    the first change after the last emission; its last content is what goes out.
    """
    windowed = skew.anchored_windows(
        changes.select(key, time, tie, content_hash), [key], time, quiet_seconds, hot_rows=hot_rows
    )
    last = windowed.groupBy(key, "window_start_us").agg(
        F.max_by(content_hash, F.struct(time, tie)).alias(content_hash),
        F.count(F.lit(1)).alias("changes_folded"),
    )
    emitted = last.withColumn(
        "emitted_at", F.timestamp_micros(F.col("window_start_us") + quiet_seconds * 1_000_000)
    )
    lagged = skew.lag_in_key(
        emitted, [key], ["emitted_at"], {"__h": content_hash}, skew.day_chunk("emitted_at"), hot_rows
    )
    return lagged.where(~F.col("__h").eqNullSafe(F.col(content_hash))).select(
        key, "emitted_at", content_hash, "changes_folded"
    )


def reprocess_stale(
    offers: DataFrame, reextracted: DataFrame, current_version: str, key: str = "offer_uid"
) -> DataFrame:
    """Take the new extraction for rows below ``current_version``, by its number; first_seen_at stays."""
    number = lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    stale = offers.where(number(F.col("normalizer_version")) < number(F.lit(current_version))).select(
        key, F.col("first_seen_at").alias("__first")
    )
    return (
        reextracted.join(stale, key)
        .withColumn("first_seen_at", F.least("first_seen_at", "__first"))
        .withColumn("normalizer_version", F.lit(current_version))
        .drop("__first")
    )


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def seller_provision(events: DataFrame) -> DataFrame:
    """A seller appears with its first offer; later offers only fill blanks."""
    order = F.struct("occurred_at", "event_id")
    domain = url_domain(F.col("url"))
    return events.groupBy("seller_key").agg(
        F.min("occurred_at").alias("first_seen_at"),
        F.min_by(F.when(domain != "", domain), F.when(domain != "", order)).alias("domain"),
        F.min_by("source_key", F.when(F.col("source_key").isNotNull(), order)).alias("source_key"),
    ).withColumn("name", F.col("seller_key"))

"""Ordered per-key work that stays parallel when one key is huge.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Keys with more than
``hot_rows`` rows are looked for first (one map-side-combined count; the result, at most
rows / ``hot_rows`` keys, is written to the checkpoint folder). Without any, the plain
window is the best plan and is used. Otherwise hot keys are cut into chunks along their
own sort order; each (key, chunk) is processed alone and only one small row per chunk
is exchanged to stitch the pieces, while cold keys keep a single null chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.params import HOT_KEY_ROWS
from karvan.session import cut_lineage

CHUNK = "__chunk"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*keys)
    )


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame | None:
    """The hot keys as a small stored table, or None when there are none."""
    hot = cut_lineage(hot_keys(df, keys, hot_rows))
    return None if hot.isEmpty() else hot


def with_chunks(df: DataFrame, keys: Sequence[str], chunk: Column, hot: DataFrame | None) -> DataFrame:
    """Add ``__chunk``: null for cold keys, ``chunk`` (a long) for hot ones.

    ``hot`` holds at most rows / hot_rows keys: that bound makes the broadcast safe.
    """
    if hot is None:
        return df.withColumn(CHUNK, F.lit(None).cast("long"))
    marked = hot.withColumn("__hot", F.lit(True))
    return (
        df.join(F.broadcast(marked), list(keys), "left")
        .withColumn(CHUNK, F.when(F.col("__hot"), chunk.cast("long")))
        .drop("__hot")
    )


def chunk_window(keys: Sequence[str], hot: DataFrame | None):
    return Window.partitionBy(*keys) if hot is None else Window.partitionBy(*keys, CHUNK)


def day_chunk(ts: str | Column) -> Column:
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(86_400_000_000))


def lag_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    chunk: Column,
    hot_rows: int = HOT_KEY_ROWS,
    seen: str | None = None,
    collapse_ties: bool = False,
    hot: DataFrame | None | str = "find",
    describe: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``lag`` over ``order`` (ascending columns) for each ``{new name: column}``.

    ``seen`` names an optional boolean: does a previous row exist at all.
    ``collapse_ties`` keeps only the last row among equal ``order[0]`` first, in the
    same shuffle (``chunk`` is a function of ``order[0]``, so ties share a chunk).
    ``describe`` adds columns that are written where the rows of a key have met, so that
    they are not moved; ``order``, after its first column, and ``values`` may name them.
    """
    keys, order = list(keys), list(order)
    if isinstance(hot, str):
        hot = find_hot(df, keys, hot_rows)
    chunked = with_chunks(df, keys, chunk, hot)
    columns = df.columns
    if describe is not None:
        columns = describe(df).columns
        chunked = describe(chunked.repartition(*keys, *([] if hot is None else [CHUNK])))
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    window = chunk_window(keys, hot).orderBy(*order)
    rows = chunked
    if collapse_ties:
        rows = rows.withColumn("__next", F.lead(order[0]).over(window)).where(
            F.col("__next").isNull() | (F.col("__next") != F.col(order[0]))
        )
    rows = rows.withColumn("__prev", F.lag(packed).over(window))
    out = [*columns, *[F.col(f"__prev.{name}").alias(name) for name in values]]
    if seen:
        out.append(F.col("__prev").isNotNull().alias(seen))
    if hot is None:
        return rows.select(*out)
    tails = (
        chunked.where(F.col(CHUNK).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(F.max_by(packed, F.struct(*order)).alias("__tail"))
    )
    carry = tails.select(
        *keys,
        CHUNK,
        F.lag("__tail").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__carry"),
    ).where(F.col("__carry").isNotNull())
    joined = rows.join(carry, [*keys, CHUNK], "left").withColumn(
        "__prev", F.coalesce("__prev", "__carry")
    )
    return joined.select(*out)


def prefix_sum_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    name: str,
    chunk: Column,
    hot_rows: int = HOT_KEY_ROWS,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before this one.

    ``chunk`` must grow with the sort order (it may be coarser, never against it).
    """
    keys = list(keys)
    if isinstance(hot, str):
        hot = find_hot(df, keys, hot_rows)
    chunked = with_chunks(df, keys, chunk, hot).withColumn("__v", value)
    window = chunk_window(keys, hot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunked.withColumn("__local", F.coalesce(F.sum("__v").over(window), F.lit(0)))
    if hot is None:
        return rows.select(*df.columns, F.col("__local").alias(name))
    totals = (
        chunked.where(F.col(CHUNK).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(F.sum("__v").alias("__total"))
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, CHUNK, F.sum("__total").over(before).alias("__offset"))
    return rows.join(offsets, [*keys, CHUNK], "left").select(
        *df.columns, (F.col("__local") + F.coalesce("__offset", F.lit(0))).alias(name)
    )


def ordinal_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    chunk: Column,
    hot_rows: int = HOT_KEY_ROWS,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """``row_number`` without putting a hot key into one task."""
    counted = prefix_sum_in_key(df, keys, order, F.lit(1).cast("long"), name, chunk, hot_rows, hot)
    return counted.withColumn(name, F.col(name) + 1)


# ---------------------------------------------------------------- anchored windows


def _chain_steps(ts: np.ndarray, ttl: int) -> list[tuple[int, int]]:
    """Entry threshold -> expiry after the chunk, as a compressed step function.

    A carried window that expires at or before ``ts[i]`` makes ``i`` the first
    opener; following openers to the end of the chunk gives the exit expiry.
    """
    following = np.searchsorted(ts, ts + ttl, side="left")
    last = np.arange(len(ts))
    for i in range(len(ts) - 1, -1, -1):
        if following[i] < len(ts):
            last[i] = last[following[i]]
    exits = ts[last] + ttl
    limit = int(np.searchsorted(ts, ts[0] + ttl, side="left"))
    steps: list[tuple[int, int]] = []
    for i in range(min(limit + 1, len(ts))):
        if steps and steps[-1][1] == int(exits[i]):
            steps[-1] = (int(ts[i]), int(exits[i]))
        else:
            steps.append((int(ts[i]), int(exits[i])))
    return steps


def _entry_states(hot: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Expiry of the window open at the start of every hot chunk."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.select(*keys).schema)

    def chunk_steps(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["__us"].to_numpy())
        steps = _chain_steps(ts, ttl)
        head = {k: pdf[k].iloc[0] for k in [*keys, CHUNK]}
        return pd.DataFrame([{**head, "__until": a, "__exit": b} for a, b in steps])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([CHUNK, "__until"])
        expiry = None
        rows = []
        for chunk, steps in pdf.groupby(CHUNK, sort=True):
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, CHUNK: chunk, "__entry": expiry})
            for until, leave in zip(steps["__until"], steps["__exit"], strict=True):
                if expiry is None or until >= expiry:
                    expiry = leave
                    break
        out = pd.DataFrame(rows)
        out["__entry"] = out["__entry"].astype("Int64")
        return out

    steps = (
        hot.select(*keys, CHUNK, "__us")
        .groupBy(*keys, CHUNK)
        .applyInPandas(chunk_steps, f"{key_schema}, {CHUNK} long, __until long, __exit long")
    )
    return steps.groupBy(*keys).applyInPandas(compose, f"{key_schema}, {CHUNK} long, __entry long")


def anchored_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ttl_seconds: int,
    chunk_seconds: int = 86_400,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Windows that open at a key's first event and close ``ttl`` later.

    The next event at or after the close opens the next window. Neither ``window()``
    nor a RANGE frame can say this, because every window depends on the one before.
    Adds ``window_start_us``; rows of equal time share their window.
    """
    keys = list(keys)
    ttl = ttl_seconds * 1_000_000
    width = max(chunk_seconds, 2 * ttl_seconds) * 1_000_000
    timed = df.withColumn("__us", F.unix_micros(F.col(ts)))
    hot = find_hot(df, keys, hot_rows)
    chunked = with_chunks(timed, keys, F.floor(F.col("__us") / F.lit(width)), hot)
    times = chunked.select(*keys, CHUNK, "__us").distinct()
    if hot is None:
        times = times.withColumn("__entry", F.lit(None).cast("long")).repartition(*[F.col(k) for k in keys])
    else:
        entries = _entry_states(chunked.where(F.col(CHUNK).isNotNull()), keys, ttl)
        times = times.join(entries, [*keys, CHUNK], "left").repartition(*[F.col(k) for k in keys], F.col(CHUNK))
    prepared = times.sortWithinPartitions(*keys, CHUNK, "__us")
    slim = prepared.select(
        F.to_json(F.struct(*keys, CHUNK)).alias("__k"), *keys, CHUNK, "__us", "__entry"
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, expiry = None, 0, None
        for pdf in batches:
            starts = np.empty(len(pdf), dtype="int64")
            entry = pdf["__entry"].tolist()
            for i, (key, us) in enumerate(
                zip(pdf["__k"].tolist(), pdf["__us"].tolist(), strict=True)
            ):
                if key != current:
                    current = key
                    expiry = None if entry[i] is None or entry[i] != entry[i] else int(entry[i])
                    start = 0 if expiry is None else expiry - ttl
                if expiry is None or us >= expiry:
                    start, expiry = us, us + ttl
                starts[i] = start
            out = pdf[[*keys, CHUNK, "__us"]].copy()
            out["window_start_us"] = starts
            out[CHUNK] = out[CHUNK].astype("Int64")
            yield out

    starts = slim.mapInPandas(fold, f"{key_schema}, {CHUNK} long, __us long, window_start_us long")
    return timed.join(starts.drop(CHUNK), [*keys, "__us"], "left").select(
        *df.columns, "window_start_us"
    )

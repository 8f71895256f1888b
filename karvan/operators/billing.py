"""Outbound clicks: privacy hashes, fraud flags, rates and the prepaid ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.functions.ids import hmac_sha256
from karvan.operators import skew
from karvan.params import HOT_KEY_ROWS, FraudParams
from karvan.session import cut_lineage

#: User agents that are not people (fixed value).
BOTS = "(?i)bot|crawler|spider|slurp|headless|facebookexternalhit|bingpreview|curl|wget"


def pseudonymize_clicks(clicks: DataFrame, key: str) -> DataFrame:
    """Keyed hashes of address, agent and their pair; the raw values are dropped."""
    ip = hmac_sha256(key, F.col("ip_address"))
    agent = hmac_sha256(key, F.col("user_agent"))
    hashed = clicks.withColumn("ip_hash", ip).withColumn("user_agent_hash", agent)
    pair = F.concat_ws(":", "ip_hash", "user_agent_hash")
    return hashed.withColumn("fingerprint_hash", hmac_sha256(key, pair)).drop("ip_address", "user_agent")


def static_fraud_flags(user_agent: Column, referer: Column, hosts: Sequence[str]) -> Column:
    """Array of reasons visible on the request alone."""
    host = F.lower(F.coalesce(F.try_parse_url(referer, F.lit("HOST")), F.lit("")))
    allowed = F.lit(False)
    for name in hosts:
        allowed = allowed | (host == name) | host.endswith(f".{name}")
    missing = referer.isNull() | (referer == "")
    reasons = F.array(
        F.when(user_agent.rlike(BOTS), "known_bot"),
        F.when(missing, "missing_referer"),
        F.when(~missing & ~allowed, "foreign_referer"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def _place_in_window(
    clicks: DataFrame, keys: list[str], seconds: int, name: str, hot_rows: int
) -> DataFrame:
    """click_id -> 1-based place inside the key's anchored window.

    A window never spans more than ``seconds``, so ranking inside it is bounded work. A
    click with a null key belongs to no window and stands alone; redelivered clicks count once.
    """
    slim = clicks.select("click_id", "occurred_at", *keys).dropDuplicates(["click_id"])
    windowed = skew.anchored_windows(slim, keys, "occurred_at", seconds, hot_rows=hot_rows)
    order = Window.partitionBy(*keys, "window_start_us").orderBy("occurred_at", "click_id")
    place = F.when(F.col("window_start_us").isNotNull(), F.row_number().over(order)).otherwise(1)
    return windowed.select("click_id", place.cast("long").alias(name))


def anchored_rate_limit(clicks: DataFrame, p: FraudParams = FraudParams(), hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Clicks past the limit within the window the (seller, address) opened."""
    placed = _place_in_window(clicks, ["seller_key", "ip_hash"], p.ip_window_s, "ip_count", hot_rows)
    return placed.withColumn("ip_rate_limit", F.col("ip_count") > p.ip_limit)


def repeat_fingerprint(clicks: DataFrame, p: FraudParams = FraudParams(), hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Clicks on an offer after the first one of the same fingerprint's window."""
    placed = _place_in_window(clicks, ["offer_uid", "fingerprint_hash"], p.fingerprint_s, "n", hot_rows)
    return placed.select("click_id", (F.col("n") > 1).alias("repeat_fingerprint"))


def seller_velocity(clicks: DataFrame, p: FraudParams = FraudParams(), hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Clicks past the seller's limit within the window the seller's first click opened."""
    placed = _place_in_window(clicks, ["seller_key"], p.velocity_window_s, "velocity_count", hot_rows)
    return placed.withColumn("seller_velocity", F.col("velocity_count") > p.velocity_limit)


def velocity_reviews(clicks: DataFrame, velocity: DataFrame, p: FraudParams = FraudParams()) -> DataFrame:
    """One review per seller and calendar bucket, carrying the first count past the limit."""
    bucket = F.floor(F.unix_timestamp("occurred_at") / p.velocity_window_s)
    over = velocity.where("seller_velocity").join(
        clicks.select("click_id", "seller_key", "occurred_at"), "click_id"
    )
    return over.groupBy("seller_key", bucket.alias("bucket")).agg(
        F.min_by("velocity_count", F.struct("occurred_at", "click_id")).alias("priority")
    ).withColumn("request_uid", F.concat_ws(":", F.lit("billing-velocity"), "seller_key", "bucket"))


def nonce_replay(clicks: DataFrame, p: FraudParams = FraudParams(), hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Keep only the first use of a nonce inside its lifetime."""
    placed = _place_in_window(clicks, ["nonce"], p.nonce_ttl_s, "n", hot_rows).where("n = 1")
    return clicks.join(placed.select("click_id"), "click_id", "left_semi")


def fraud_reasons(
    clicks: DataFrame, hosts: Sequence[str], p: FraudParams = FraudParams(), hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """All reasons per click. ``clicks`` carries hashes plus raw agent and referer."""
    static = static_fraud_flags(F.col("user_agent"), F.col("referer"), hosts)
    rate = anchored_rate_limit(clicks, p, hot_rows)
    repeat = repeat_fingerprint(clicks, p, hot_rows)
    velocity = seller_velocity(clicks, p, hot_rows)
    joined = (
        clicks.withColumn("__static", static)
        .join(rate.select("click_id", "ip_rate_limit"), "click_id")
        .join(repeat, "click_id")
        .join(velocity.select("click_id", "seller_velocity"), "click_id")
    )
    dynamic = F.array(
        *[F.when(F.col(c), c) for c in ("ip_rate_limit", "repeat_fingerprint", "seller_velocity")]
    )
    reasons = F.concat("__static", F.filter(dynamic, lambda r: r.isNotNull()))
    return (
        joined.withColumn("fraud_reasons", reasons)
        .withColumn("is_suspicious", F.size("fraud_reasons") > 0)
        .drop("__static", "ip_rate_limit", "repeat_fingerprint", "seller_velocity")
    )


# ----------------------------------------------------------------------------- rates


def active_rate_card(rates: DataFrame, at: Column) -> DataFrame:
    return rates.where(
        F.col("active") & (F.col("effective_from") <= at)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > at))
    )


def cpc_rate_lookup(clicks: DataFrame, rates: DataFrame) -> DataFrame:
    """Freeze the rate that applied to each click.

    Price band meets validity interval. The rate card is configuration (a page of
    rows), so it enters as one array from a scalar subquery and each click picks
    from it in place: no join and no shuffle.
    """
    packed = F.struct(
        "min_price_toman", "max_price_toman", "effective_from", "effective_to", "cost_toman", "name"
    )
    card = rates.where("active").agg(F.collect_list(packed)).scalar()
    price, at = F.col("price_toman"), F.col("occurred_at")

    def fits(r: Column) -> Column:
        valid = (r["effective_from"] <= at) & (r["effective_to"].isNull() | (r["effective_to"] > at))
        band = (r["min_price_toman"] <= price) & (
            r["max_price_toman"].isNull() | (r["max_price_toman"] > price)
        )
        return valid & (price.isNull() | band)

    # Highest band for a known price, lowest for an unknown one; then the newest.
    def rank(r: Column) -> Column:
        band = F.when(price.isNull(), -r["min_price_toman"]).otherwise(r["min_price_toman"])
        return F.struct(
            band.alias("band"), r["effective_from"].alias("since"),
            r["cost_toman"].alias("cost"), r["name"].alias("name"),
        )

    best = F.array_max(F.transform(F.filter("__card", fits), rank))
    return (
        clicks.withColumn("__card", card)
        .withColumn("__rate", best)
        .withColumn("rate_name", F.col("__rate.name"))
        .withColumn("rate_cost", F.col("__rate.cost"))
        .drop("__card", "__rate")
    )


# ---------------------------------------------------------------------------- ledger

LEDGER_SCHEMA = (
    "seller_key string, event_id long, occurred_us long, kind string, amount_toman long, "
    "balance_after_toman long, panel_offers_active boolean, state_changed boolean, reason string"
)


def wallet_topup_adjust(topups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): the first use of a reference counts.

    A repeat with the same seller and amount is a harmless retry; anything else is a
    conflict to report.
    """
    first = topups.groupBy("reference").agg(
        F.min_by(F.struct("topup_id", "seller_key", "amount_toman"), F.struct("occurred_at", "topup_id")).alias("f")
    )
    joined = topups.join(first, "reference")
    is_first = F.col("f.topup_id") == F.col("topup_id")
    same = (F.col("f.seller_key") == F.col("seller_key")) & (F.col("f.amount_toman") == F.col("amount_toman"))
    accepted = joined.where(is_first).select(*topups.columns)
    conflicts = joined.where(~is_first & ~same).select(*topups.columns)
    return accepted, conflicts


def ledger_events(clicks: DataFrame, topups: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """One ordered stream per seller: top-ups before clicks at equal times.

    Clicks that can never be charged (not a panel offer, suspicious, no rate) do not
    touch the ledger and are left out. A click delivered again is charged once, at its
    first time.
    """
    chargeable = clicks.where("is_panel_offer AND NOT is_suspicious AND coalesce(rate_cost, 0) > 0")
    first = F.min_by(F.struct("seller_key", "occurred_at", "rate_cost"), F.struct("occurred_at", "seller_key", "rate_cost"))
    chargeable = chargeable.groupBy("click_id").agg(first.alias("c")).select("click_id", "c.*")
    us = F.unix_micros("occurred_at").alias("occurred_us")
    parts = [
        topups.select("seller_key", F.col("topup_id").alias("event_id"), us, F.lit(0).alias("prio"),
                      F.lit("topup").alias("kind"), "amount_toman"),
        chargeable.select("seller_key", F.col("click_id").alias("event_id"), us, F.lit(2).alias("prio"),
                          F.lit("charge").alias("kind"), (-F.col("rate_cost")).alias("amount_toman")),
    ]
    if adjustments is not None:
        parts.append(
            adjustments.select("seller_key", F.col("adjust_id").alias("event_id"), us, F.lit(1).alias("prio"),
                               F.lit("manual").alias("kind"), "amount_toman")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply the wallet rules to rows sorted by seller, chunk and time; state is one wallet."""
    at, balance, active = None, 0, True
    for pdf in batches:
        rows = []
        for key, chunk, event, us, kind, amount, entry, open_ in zip(
            pdf["seller_key"], pdf["chunk"], pdf["event_id"], pdf["occurred_us"], pdf["kind"], pdf["amount_toman"],
            pdf["entry_balance"], pdf["entry_active"], strict=True,
        ):
            if (key, chunk) != at:
                at, balance, active = (key, chunk), entry, open_
            before, applied, reason = active, 0, None
            if kind == "topup":
                applied, active = amount, True
            elif kind == "manual":
                if balance + amount >= 0:
                    applied = amount
                    if balance + amount == 0:
                        active, reason = False, "zero_balance"
                    elif amount > 0:
                        active = True
                else:
                    reason = "would_go_negative"
            elif active and balance + amount >= 0:
                applied = amount
                if balance + amount == 0:
                    active, reason = False, "zero_balance"
            elif active:
                active, reason = False, "insufficient_balance"
            balance += applied
            rows.append((key, event, us, kind, applied, balance, active, before != active, reason))
        yield pd.DataFrame(
            rows,
            columns=[
                "seller_key", "event_id", "occurred_us", "kind", "amount_toman",
                "balance_after_toman", "panel_offers_active", "state_changed", "reason",
            ],
        )


#: Events of one wallet that are summed up in one step, and a balance above all others.
LEDGER_CHUNK, MOST = 256, 1 << 62


class BalanceFunction:
    """What a run of events does to a wallet, for every balance and state it may start with.

    Pieces of entry balances [lo, hi) with one entry state share a shift of the balance and a
    state at the end. An event cuts a piece where the balance just suffices for it.
    """

    def __init__(self) -> None:
        self.lo, self.hi = np.zeros(2, np.int64), np.full(2, MOST)
        self.entry, self.active = np.array([True, False]), np.array([True, False])
        self.shift = np.zeros(2, np.int64)

    def then(self, kind: str, amount: int) -> None:
        if kind == "topup":
            self.shift = self.shift + amount
            self.active = np.ones(len(self.lo), bool)
            self._merge()
            return
        concerned = np.ones(len(self.lo), bool) if kind == "manual" else self.active
        enough = -amount - self.shift
        self._cut(np.where(concerned, enough, -1), np.where(concerned, enough + 1, -1))
        concerned = np.ones(len(self.lo), bool) if kind == "manual" else self.active
        enough = -amount - self.shift
        paid, exact = concerned & (self.lo >= enough), concerned & (self.lo == enough) & (self.hi == enough + 1)
        self.shift = self.shift + np.where(paid, amount, 0)
        if kind == "manual":
            self.active = np.where(exact, False, self.active | paid & (amount > 0))
        else:
            self.active = self.active & paid & ~exact
        self._merge()

    def _cut(self, *points: np.ndarray) -> None:
        inner = [(p > self.lo) & (p < self.hi) for p in points]
        if not any(i.any() for i in inner):
            return
        lo = np.concatenate([self.lo, *[p[i] for p, i in zip(points, inner, strict=True)]])
        of = np.concatenate([np.arange(len(self.lo)), *[np.flatnonzero(i) for i in inner]])
        order = np.lexsort((lo, of))
        lo, of = lo[order], of[order]
        last = np.r_[of[1:] != of[:-1], True]
        self.hi = np.where(last, self.hi[of], np.r_[lo[1:], 0])
        self.lo, self.entry, self.active, self.shift = lo, self.entry[of], self.active[of], self.shift[of]

    def _merge(self) -> None:
        same = (self.lo[1:] == self.hi[:-1]) & (self.entry[1:] == self.entry[:-1]) & (self.active[1:] == self.active[:-1]) & (self.shift[1:] == self.shift[:-1])
        if same.any():
            first = np.flatnonzero(np.r_[True, ~same])
            self.hi = self.hi[np.r_[first[1:] - 1, len(self.hi) - 1]]
            self.lo, self.entry, self.active, self.shift = self.lo[first], self.entry[first], self.active[first], self.shift[first]


def _entry_states(events: DataFrame, key: str) -> DataFrame:
    """(seller_key, chunk, entry_balance, entry_active): each chunk of a wallet, where it starts.

    Chunks are summed up as functions of the state they start with, all in parallel; one pass over
    these functions, a row per chunk, gives the states.
    """
    shape = f"seller_key {key}, chunk long, lo array<long>, entry array<boolean>, shift array<long>, active array<boolean>"

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["occurred_us", "prio", "event_id"])
        fn = BalanceFunction()
        for kind, amount in zip(pdf["kind"], pdf["amount_toman"], strict=True):
            fn.then(kind, int(amount))
        row = {"seller_key": pdf["seller_key"].iloc[0], "chunk": pdf["chunk"].iloc[0]}
        return pd.DataFrame([row | {"lo": fn.lo, "entry": fn.entry, "shift": fn.shift, "active": fn.active}])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seller, balance, active = None, 0, True
        for pdf in batches:
            rows = []
            for key_, chunk, lo, entry, shift, after in zip(*[pdf[c] for c in ("seller_key", "chunk", "lo", "entry", "shift", "active")], strict=True):
                if key_ != seller:
                    seller, balance, active = key_, 0, True
                rows.append((key_, chunk, balance, active))
                at = np.flatnonzero(entry == active)
                at = at[np.searchsorted(lo[at], balance, side="right") - 1]
                balance, active = int(balance + shift[at]), bool(after[at])
            yield pd.DataFrame(rows, columns=["seller_key", "chunk", "entry_balance", "entry_active"])

    functions = events.groupBy("seller_key", "chunk").applyInPandas(summed, shape)
    ordered = functions.repartition("seller_key").sortWithinPartitions("seller_key", "chunk")
    return ordered.mapInPandas(walk, f"seller_key {key}, chunk long, entry_balance long, entry_active boolean")


def wallet_charge(events: DataFrame, hot_rows: int = HOT_KEY_ROWS, chunk_events: int = LEDGER_CHUNK) -> DataFrame:
    """All-or-nothing charging in event order.

    While a wallet never runs dry every charge succeeds, so the balance is a plain
    running sum, computed in parallel even inside one seller. Wallets whose running sum ever
    touches zero are cut into chunks of ``chunk_events``: every chunk is summed up as a function
    of the balance it starts with, the starts follow from these functions, and the chunks are
    then folded by themselves. A wallet of one chunk starts at zero and needs no function.
    """
    order = ["occurred_us", "prio", "event_id"]
    day = F.floor(F.col("occurred_us") / 86_400_000_000)
    summed = skew.prefix_sum_in_key(events, ["seller_key"], order, F.col("amount_toman"), "before", day, hot_rows)
    summed = summed.withColumn("balance", F.col("before") + F.col("amount_toman"))
    dry = summed.groupBy("seller_key").agg(F.min("balance").alias("lowest")).where("lowest <= 0")
    solvent = summed.join(dry.select("seller_key"), "seller_key", "left_anti").select(
        "seller_key", "event_id", "occurred_us", "kind", "amount_toman",
        F.col("balance").alias("balance_after_toman"), F.lit(True).alias("panel_offers_active"),
        F.lit(False).alias("state_changed"), F.lit(None).cast("string").alias("reason"),
    )
    drying = events.join(dry.select("seller_key"), "seller_key", "left_semi")
    numbered = cut_lineage(
        skew.ordinal_in_key(drying, ["seller_key"], order, "ordinal", day, hot_rows)
        .withColumn("chunk", F.floor((F.col("ordinal") - 1) / chunk_events))
    )
    long = numbered.where(F.col("chunk") > 0).select("seller_key").distinct()
    starts = _entry_states(numbered.join(long, "seller_key", "left_semi"), events.schema["seller_key"].dataType.simpleString())
    folded = (
        numbered.join(starts, ["seller_key", "chunk"], "left")
        .withColumn("entry_balance", F.coalesce("entry_balance", F.lit(0)))
        .withColumn("entry_active", F.coalesce("entry_active", F.lit(True)))
        .repartition("seller_key", "chunk")
        .sortWithinPartitions("seller_key", "chunk", *order)
        .select("seller_key", "chunk", "event_id", "occurred_us", "kind", "amount_toman", "entry_balance", "entry_active")
        .mapInPandas(_fold, LEDGER_SCHEMA)
    )
    return solvent.unionByName(folded)


def billing_state_changes(ledger: DataFrame) -> DataFrame:
    """Only transitions of the panel state are published."""
    return ledger.where("state_changed").select(
        "seller_key", "occurred_us", "event_id", "panel_offers_active",
        F.when(~F.col("panel_offers_active"), F.col("reason")).alias("suspension_reason"),
    )


def wallet_statement(ledger: DataFrame, last: int = 100) -> DataFrame:
    """Newest transactions per seller; the rank filter cuts before the shuffle."""
    newest = Window.partitionBy("seller_key").orderBy(F.desc("occurred_us"), F.desc("event_id"))
    moved = ledger.where("amount_toman <> 0")
    return moved.withColumn("line", F.row_number().over(newest)).where(F.col("line") <= last)


# --------------------------------------------------------------------------- reports


def recorded_clicks(clicks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Clicks with the cost that was really charged."""
    charged = ledger.where("kind = 'charge' AND amount_toman < 0").select(
        F.col("event_id").alias("click_id"), (-F.col("amount_toman")).alias("cost_toman")
    )
    return clicks.join(charged, "click_id", "left").withColumn(
        "cost_toman", F.coalesce("cost_toman", F.lit(0).cast("long"))
    )


def seller_click_stats(clicks: DataFrame) -> DataFrame:
    """Totals and per-UTC-day numbers; the total row has a null day.

    Days are reduced first and rolled up from there, so the click rows are not doubled.
    """
    daily = clicks.groupBy("seller_key", F.to_date("occurred_at").alias("day")).agg(
        F.count(F.lit(1)).alias("clicks"),
        F.count_if("is_suspicious").alias("suspicious_clicks"),
        F.count_if(F.col("cost_toman") > 0).alias("charged_clicks"),
        F.sum("cost_toman").alias("spend_toman"),
    )
    sums = [F.sum(c).alias(c) for c in ("clicks", "suspicious_clicks", "charged_clicks", "spend_toman")]
    return daily.groupingSets([["seller_key"], ["seller_key", "day"]], "seller_key", "day").agg(*sums)


def reconcile_day(clicks: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per day: click spend against charge transactions, and what does not pair up.

    ``transactions``: click_id, amount_toman (negative), occurred_at.
    """
    left = clicks.select("click_id", F.to_date("occurred_at").alias("c_day"), "cost_toman")
    right = transactions.select("click_id", F.to_date("occurred_at").alias("t_day"), (-F.col("amount_toman")).alias("charged"))
    both = left.join(right, "click_id", "full_outer").withColumn("day", F.coalesce("c_day", "t_day"))
    spend, charged = F.coalesce(F.sum("cost_toman"), F.lit(0)), F.coalesce(F.sum("charged"), F.lit(0))
    return both.groupBy("day").agg(
        spend.alias("click_spend"),
        charged.alias("transaction_spend"),
        F.count_if((F.col("cost_toman") > 0) & F.col("charged").isNull()).alias("charged_without_transaction"),
        F.count_if(
            F.col("charged").isNotNull() & ~F.col("charged").eqNullSafe(F.col("cost_toman"))
        ).alias("mismatched_charges"),
    )


def fraud_report(clicks: DataFrame) -> DataFrame:
    """Suspicious clicks per day and seller, most first."""
    return (
        clicks.where("is_suspicious")
        .groupBy(F.to_date("occurred_at").alias("day"), "seller_key")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("day", F.desc("count"), "seller_key")
    )


# ---------------------------------------------------------------- downstream signals


def click_signal_7d(clicks: DataFrame, known_offers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Clicks per offer we crawl in the trailing window, each click once."""
    recent = clicks.where((F.col("occurred_at") >= now - F.make_interval(days=F.lit(days))) & (F.col("occurred_at") <= now))
    return (
        recent.select("click_id", "offer_uid").dropDuplicates(["click_id"])
        .join(known_offers.select("offer_uid").distinct(), "offer_uid", "left_semi")
        .groupBy("offer_uid").agg(F.count(F.lit(1)).alias("count_7d"))
    )


def click_counters(clicks: DataFrame) -> DataFrame:
    """Totals per (product, offer) and, with a null offer, per product."""
    per_offer = clicks.groupBy("product_uid", "offer_uid").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.count_if("is_suspicious").alias("suspicious"),
        F.max("occurred_at").alias("last_click_at"),
    )
    per_product = per_offer.groupBy("product_uid").agg(
        F.sum("clicks").alias("clicks"), F.sum("suspicious").alias("suspicious"),
        F.max("last_click_at").alias("last_click_at"),
    )
    return per_offer.unionByName(per_product.withColumn("offer_uid", F.lit(None).cast("string")))

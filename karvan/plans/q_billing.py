"""Billing and fraud queries. Limits are lowered: the event table has few clicks per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import billing
from karvan.params import FraudParams
from karvan.plans import views as v
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage

KEY = "test-key"
HOSTS = ("shop.example",)
LIMITS = FraudParams(
    ip_limit=2, ip_window_s=2 * 86400, fingerprint_s=3 * 86400, velocity_limit=5,
    velocity_window_s=4 * 3600, nonce_ttl_s=86400,
)


def _hmac_sql(value: str) -> str:
    raw = KEY.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in raw).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


add_view(
    "hashed_clicks",
    "clicks",
    f"""
  SELECT *, {_hmac_sql("ip_hash || ':' || user_agent_hash")} AS fingerprint_hash FROM (
    SELECT *, {_hmac_sql("ip_address")} AS ip_hash, {_hmac_sql("user_agent")} AS user_agent_hash FROM clicks)""",
)


def _anchored(name: str, source: str, keys: str, seconds: int) -> None:
    """Recursive oracle: numbered rows per key walked one by one."""
    cols = [k.strip() for k in keys.split(",")]
    join = " AND ".join(f"n.{c} = w.{c}" for c in cols)
    add_view(
        f"{name}_num",
        source,
        f"""SELECT click_id, {keys}, epoch_us(occurred_at) AS us,
            row_number() OVER (PARTITION BY {keys} ORDER BY occurred_at, click_id) AS rn FROM {source}""",
    )
    add_view(
        f"{name}_walk",
        f"{name}_num",
        f"""SELECT click_id, {keys}, rn, us AS start, CAST(1 AS BIGINT) AS n FROM {name}_num WHERE rn = 1
        UNION ALL
        SELECT n.click_id, {", ".join("n." + c for c in cols)}, n.rn, CASE WHEN n.us >= w.start + {seconds * 1_000_000} THEN n.us ELSE w.start END,
          CASE WHEN n.us >= w.start + {seconds * 1_000_000} THEN 1 ELSE w.n + 1 END
        FROM {name}_walk w JOIN {name}_num n ON n.rn = w.rn + 1 AND {join}""",
    )


_anchored("ip", "hashed_clicks", "seller_key, ip_hash", LIMITS.ip_window_s)
_anchored("fp", "hashed_clicks", "offer_uid, fingerprint_hash", LIMITS.fingerprint_s)
_anchored("vel", "hashed_clicks", "seller_key", LIMITS.velocity_window_s)
add_view("nonce_clicks", "clicks", "SELECT *, 'n' || (click_id % 97) AS nonce FROM clicks")
_anchored("nonce", "nonce_clicks", "nonce", LIMITS.nonce_ttl_s)
STATIC = """list_filter([CASE WHEN regexp_matches(user_agent, '(?i)bot|crawler') THEN 'known_bot' END,
    CASE WHEN referer IS NULL THEN 'missing_referer' END, CASE WHEN referer LIKE '%other.example%' THEN 'foreign_referer' END], lambda x: x IS NOT NULL)"""
add_view(
    "flagged",
    "hashed_clicks ip_walk fp_walk vel_walk",
    f"""
  SELECT c.*, {STATIC} || list_filter([CASE WHEN i.n > 2 THEN 'ip_rate_limit' END, CASE WHEN f.n > 1 THEN 'repeat_fingerprint' END,
      CASE WHEN x.n > 5 THEN 'seller_velocity' END], lambda x: x IS NOT NULL) AS reasons
  FROM hashed_clicks c JOIN ip_walk i USING (click_id) JOIN fp_walk f USING (click_id) JOIN vel_walk x USING (click_id)""",
)
add_view(
    "rated",
    "clicks rate_card",
    """
  SELECT c.click_id, r.name AS rate_name, CAST(r.cost_toman AS BIGINT) AS rate_cost FROM clicks c LEFT JOIN rate_card r ON r.active
    AND r.effective_from <= c.occurred_at AND (r.effective_to IS NULL OR r.effective_to > c.occurred_at)
    AND (c.price_toman IS NULL OR (r.min_price_toman <= c.price_toman AND (r.max_price_toman IS NULL OR r.max_price_toman > c.price_toman)))
  QUALIFY row_number() OVER (PARTITION BY c.click_id ORDER BY CASE WHEN c.price_toman IS NULL THEN r.min_price_toman ELSE -r.min_price_toman END, r.effective_from DESC) = 1""",
)
add_view(
    "ledger_in",
    "flagged rated topups",
    """
  SELECT *, row_number() OVER (PARTITION BY seller_key ORDER BY us, prio, event_id) AS rn FROM (
    SELECT seller_key, topup_id AS event_id, epoch_us(occurred_at) AS us, 0 AS prio, 'topup' AS kind, amount_toman FROM topups WHERE topup_id % 4 <> 1
    UNION ALL SELECT seller_key, topup_id, epoch_us(occurred_at), 1, 'manual', CASE WHEN topup_id % 8 = 1 THEN -amount_toman ELSE amount_toman END FROM topups WHERE topup_id % 4 = 1
    UNION ALL SELECT seller_key, click_id, epoch_us(occurred_at), 2, 'charge', -rate_cost FROM flagged JOIN rated USING (click_id)
      WHERE is_panel_offer AND len(reasons) = 0 AND coalesce(rate_cost, 0) > 0)""",
)
add_view(
    "ledger",
    "ledger_in",
    """
  SELECT seller_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS us, '' AS kind, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS balance, true AS active, true AS was,
    CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT seller_key FROM ledger_in)
  UNION ALL
  SELECT i.seller_key, i.rn, i.event_id, i.us, i.kind,
    CASE WHEN i.kind = 'topup' THEN i.amount_toman WHEN i.kind = 'manual' THEN CASE WHEN l.balance + i.amount_toman >= 0 THEN i.amount_toman ELSE 0 END
      WHEN l.active AND l.balance + i.amount_toman >= 0 THEN i.amount_toman ELSE 0 END,
    l.balance + CASE WHEN i.kind = 'topup' THEN i.amount_toman WHEN i.kind = 'manual' THEN CASE WHEN l.balance + i.amount_toman >= 0 THEN i.amount_toman ELSE 0 END
      WHEN l.active AND l.balance + i.amount_toman >= 0 THEN i.amount_toman ELSE 0 END,
    CASE WHEN i.kind = 'topup' THEN true WHEN i.kind = 'manual' THEN CASE WHEN l.balance + i.amount_toman < 0 THEN l.active WHEN l.balance + i.amount_toman = 0 THEN false WHEN i.amount_toman > 0 THEN true ELSE l.active END
      ELSE l.active AND l.balance + i.amount_toman > 0 END,
    l.active,
    CASE WHEN i.kind = 'topup' THEN NULL WHEN i.kind = 'manual' THEN CASE WHEN l.balance + i.amount_toman < 0 THEN 'would_go_negative' WHEN l.balance + i.amount_toman = 0 THEN 'zero_balance' END
      WHEN NOT l.active THEN NULL WHEN l.balance + i.amount_toman < 0 THEN 'insufficient_balance' WHEN l.balance + i.amount_toman = 0 THEN 'zero_balance' END
  FROM ledger l JOIN ledger_in i ON i.seller_key = l.seller_key AND i.rn = l.rn + 1""",
)
add_view(
    "recorded",
    "flagged ledger",
    """
  SELECT f.click_id, f.seller_key, f.product_uid, f.offer_uid, f.occurred_at, len(reasons) > 0 AS is_suspicious, coalesce(-applied, 0) AS cost_toman
  FROM flagged f LEFT JOIN (SELECT event_id, applied FROM ledger WHERE kind = 'charge' AND applied < 0) ON event_id = click_id""",
)


def hashed(spark, d):
    c = v.clicks(spark, d)
    return billing.pseudonymize_clicks(c, KEY).join(c.select("click_id", "user_agent"), "click_id")


def flagged(spark, d):
    return billing.fraud_reasons(cut_lineage(hashed(spark, d)), HOSTS, LIMITS)


def ledger_input(spark, d):
    clicks = billing.cpc_rate_lookup(flagged(spark, d), v.rate_card(spark))
    t = v.topups(spark, d)
    adjust = t.where("topup_id % 4 = 1").select(
        F.col("topup_id").alias("adjust_id"), "seller_key", "occurred_at",
        F.when(F.col("topup_id") % 8 == 1, -F.col("amount_toman")).otherwise(F.col("amount_toman")).alias("amount_toman"),
    )
    return billing.ledger_events(clicks, t.where("topup_id % 4 <> 1"), adjust)


def ledger(spark, d):
    return billing.wallet_charge(cut_lineage(ledger_input(spark, d)))


def recorded(spark, d):
    flags = cut_lineage(flagged(spark, d))
    return billing.recorded_clicks(flags, ledger(spark, d))


@query("pseudonymize_clicks", "hashed_clicks", "SELECT click_id, ip_hash, user_agent_hash, fingerprint_hash FROM hashed_clicks")
def pseudonymize_clicks(spark, d):
    out = billing.pseudonymize_clicks(v.clicks(spark, d), KEY)
    return out.select("click_id", "ip_hash", "user_agent_hash", "fingerprint_hash")


@query("static_fraud_flags", "clicks", f"SELECT click_id, array_to_string({STATIC}, ',') AS reasons FROM clicks")
def static_fraud_flags(spark, d):
    flags = billing.static_fraud_flags(F.col("user_agent"), F.col("referer"), HOSTS)
    return v.clicks(spark, d).select("click_id", F.array_join(flags, ",").alias("reasons"))


@query("anchored_rate_limit", "ip_walk", "SELECT click_id, n AS ip_count, n > 2 AS ip_rate_limit FROM ip_walk")
def anchored_rate_limit(spark, d):
    return billing.anchored_rate_limit(hashed(spark, d), LIMITS)


@query("repeat_fingerprint", "fp_walk", "SELECT click_id, n > 1 AS repeat_fingerprint FROM fp_walk")
def repeat_fingerprint(spark, d):
    return billing.repeat_fingerprint(hashed(spark, d), LIMITS)


@query(
    "seller_velocity",
    "vel_walk hashed_clicks",
    """
  SELECT c.seller_key, epoch_us(occurred_at) // 14400000000 AS bucket, arg_min(n, (occurred_at, click_id)) AS priority,
    'billing-velocity:' || c.seller_key || ':' || (epoch_us(occurred_at) // 14400000000) AS request_uid
  FROM vel_walk JOIN hashed_clicks c USING (click_id) WHERE n > 5 GROUP BY 1, 2""",
)
def seller_velocity(spark, d):
    c = hashed(spark, d)
    return billing.velocity_reviews(c, billing.seller_velocity(c, LIMITS), LIMITS)


@query("nonce_replay", "nonce_walk", "SELECT click_id FROM nonce_walk WHERE n = 1")
def nonce_replay(spark, d):
    c = v.clicks(spark, d).withColumn("nonce", F.concat(F.lit("n"), F.col("click_id") % 97))
    return billing.nonce_replay(c, LIMITS).select("click_id")


@query(
    "fraud_reasons",
    "flagged",
    "SELECT click_id, array_to_string(reasons, ',') AS fraud_reasons, len(reasons) > 0 AS is_suspicious FROM flagged",
)
def fraud_reasons(spark, d):
    return flagged(spark, d).select("click_id", F.array_join("fraud_reasons", ",").alias("fraud_reasons"), "is_suspicious")


@query("cpc_rate_lookup", "rated", "SELECT click_id, rate_name, rate_cost FROM rated")
def cpc_rate_lookup(spark, d):
    return billing.cpc_rate_lookup(v.clicks(spark, d), v.rate_card(spark)).select("click_id", "rate_name", "rate_cost")


@query(
    "active_rate_card",
    "rated clicks rate_card",
    """
  SELECT r.name, count(*) AS clicks FROM rate_card r JOIN clicks c ON r.active AND r.effective_from <= CAST(c.occurred_at AS DATE)
    AND (r.effective_to IS NULL OR r.effective_to > CAST(c.occurred_at AS DATE)) GROUP BY r.name""",
)
def active_rate_card(spark, d):
    """How many clicks fell on days at which each rate was valid."""
    days = v.clicks(spark, d).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    card = v.rate_card(spark).withColumn("day", F.explode(F.sequence(F.lit(span["first"]).cast("date"), F.lit(span["last"]).cast("date"))))
    valid = billing.active_rate_card(card, F.col("day").cast("timestamp"))
    return valid.join(days, "day").groupBy("name").agg(F.sum("n").alias("clicks"))


@query(
    "wallet_charge",
    "ledger",
    "SELECT seller_key, event_id, kind, applied AS amount_toman, balance AS balance_after_toman, active AS panel_offers_active, reason FROM ledger WHERE rn > 0",
)
def wallet_charge(spark, d):
    return ledger(spark, d).select(
        "seller_key", "event_id", "kind", "amount_toman", "balance_after_toman", "panel_offers_active", "reason"
    )


@query(
    "wallet_topup_adjust",
    "topups",
    """
  WITH t AS (SELECT 'r' || (topup_id % 500) AS reference, topup_id, seller_key, occurred_at, CASE WHEN topup_id % 3 = 0 THEN 100 ELSE amount_toman END AS amount_toman FROM topups),
  f AS (SELECT *, first_value(struct_pack(s := seller_key, a := amount_toman)) OVER w AS f, row_number() OVER w AS rn FROM t
    WINDOW w AS (PARTITION BY reference ORDER BY occurred_at, topup_id))
  SELECT topup_id, CASE WHEN rn = 1 THEN 'accepted' ELSE 'conflict' END AS outcome FROM f WHERE rn = 1 OR f.s <> seller_key OR f.a <> amount_toman""",
)
def wallet_topup_adjust(spark, d):
    k = F.col("topup_id")
    t = v.topups(spark, d).withColumn("reference", F.concat(F.lit("r"), k % 500)).withColumn(
        "amount_toman", F.when(k % 3 == 0, 100).otherwise(F.col("amount_toman"))
    )
    accepted, conflicts = billing.wallet_topup_adjust(t)
    return accepted.select("topup_id", F.lit("accepted").alias("outcome")).unionByName(
        conflicts.select("topup_id", F.lit("conflict").alias("outcome"))
    )


@query(
    "billing_state_changes",
    "ledger",
    "SELECT seller_key, us AS occurred_us, event_id, active AS panel_offers_active, CASE WHEN NOT active THEN reason END AS suspension_reason FROM ledger WHERE rn > 0 AND active <> was",
)
def billing_state_changes(spark, d):
    return billing.billing_state_changes(ledger(spark, d))


@query(
    "wallet_statement",
    "ledger",
    """
  SELECT seller_key, event_id, applied AS amount_toman, balance AS balance_after_toman, line FROM (
    SELECT *, row_number() OVER (PARTITION BY seller_key ORDER BY us DESC, event_id DESC) AS line FROM ledger WHERE rn > 0 AND applied <> 0) WHERE line <= 100""",
)
def wallet_statement(spark, d):
    return billing.wallet_statement(ledger(spark, d)).select("seller_key", "event_id", "amount_toman", "balance_after_toman", "line")


@query(
    "seller_click_stats",
    "recorded",
    """
  SELECT seller_key, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(*) AS clicks, count(*) FILTER (WHERE is_suspicious) AS suspicious_clicks,
    count(*) FILTER (WHERE cost_toman > 0) AS charged_clicks, CAST(sum(cost_toman) AS BIGINT) AS spend_toman
  FROM recorded GROUP BY GROUPING SETS ((seller_key), (seller_key, CAST(occurred_at AS DATE)))""",
)
def seller_click_stats(spark, d):
    return billing.seller_click_stats(recorded(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    "reconcile_day",
    "recorded",
    """
  WITH t AS (SELECT click_id, occurred_at, cost_toman + CASE WHEN click_id % 5 = 0 THEN 10 ELSE 0 END AS charged FROM recorded WHERE cost_toman > 0 AND click_id % 7 <> 0)
  SELECT CAST(CAST(r.occurred_at AS DATE) AS VARCHAR) AS day, CAST(sum(cost_toman) AS BIGINT) AS click_spend, CAST(coalesce(sum(charged), 0) AS BIGINT) AS transaction_spend,
    count(*) FILTER (WHERE cost_toman > 0 AND charged IS NULL) AS charged_without_transaction, count(*) FILTER (WHERE charged <> cost_toman) AS mismatched_charges
  FROM recorded r LEFT JOIN t USING (click_id) GROUP BY 1""",
)
def reconcile_day(spark, d):
    """Some transactions are lost (id%7=0), some are off by ten (id%5=0)."""
    rec = recorded(spark, d)
    extra = F.when(F.col("click_id") % 5 == 0, 10).otherwise(0)
    tx = rec.where("cost_toman > 0 AND click_id % 7 <> 0").select(
        "click_id", "occurred_at", (-(F.col("cost_toman") + extra)).alias("amount_toman")
    )
    return billing.reconcile_day(rec, tx).withColumn("day", F.col("day").cast("string"))


@query(
    "fraud_report",
    "flagged",
    "SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, seller_key, count(*) AS count FROM flagged WHERE len(reasons) > 0 GROUP BY 1, 2",
)
def fraud_report(spark, d):
    return billing.fraud_report(flagged(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    "click_signal_7d",
    "clicks",
    f"""
  SELECT offer_uid, count(*) AS count_7d FROM clicks WHERE occurred_at BETWEEN TIMESTAMP '{v.CLICK_NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{v.CLICK_NOW}' GROUP BY offer_uid""",
)
def click_signal_7d(spark, d):
    """Each click arrives twice and counts once."""
    c = v.clicks(spark, d)
    known = c.select("offer_uid")
    return billing.click_signal_7d(c.unionByName(c), known, v.as_of(v.CLICK_NOW))


@query(
    "click_counters",
    "flagged",
    """
  SELECT product_uid, offer_uid, count(*) AS clicks, count(*) FILTER (WHERE len(reasons) > 0) AS suspicious, CAST(epoch_us(max(occurred_at)) AS BIGINT) AS last_click_us
  FROM flagged GROUP BY ROLLUP (product_uid, offer_uid) HAVING product_uid IS NOT NULL""",
)
def click_counters(spark, d):
    out = billing.click_counters(flagged(spark, d))
    return out.withColumn("last_click_us", F.unix_micros("last_click_at")).drop("last_click_at")

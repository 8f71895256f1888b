"""The views of ``views.py`` stated in SQL, for the side-by-side check."""

from __future__ import annotations

from collections.abc import Sequence

VIEWS: dict[str, tuple[str, str]] = {
    "price_events": (
        "",
        """
  SELECT sha256(concat_ws('|', epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS event_id,
    l_shipdate AS occurred_at,
    's' || l_suppkey AS seller_key, 's' || l_suppkey AS source_key,
    'p' || (l_partkey // 10) AS external_key, 'p' || (l_partkey // 10) AS product_uid,
    substr(sha256('s' || l_suppkey || ':p' || (l_partkey // 10)), 1, 32) AS offer_uid,
    CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice / 25000) * 25000 AS BIGINT) END AS price_toman,
    CASE WHEN l_linenumber = 6 THEN 'unknown' WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
    CASE WHEN l_linenumber = 5 THEN 'unknown' WHEN l_returnflag = 'N' THEN 'genuine'
         WHEN l_returnflag = 'A' THEN 'aftermarket' ELSE 'refurbished' END AS authenticity_claim,
    l_quantity > 5 AS is_active, l_partkey AS part_key, l_suppkey AS supp_key,
    CAST(l_linenumber AS BIGINT) AS line_no, l_orderkey AS order_key
  FROM lineitem""",
    ),
    "offer_events": (
        "price_events",
        """
  SELECT e.event_id, e.occurred_at, e.seller_key, e.source_key, e.external_key, e.product_uid, e.offer_uid,
    e.price_toman, e.stock_status, e.authenticity_claim, e.is_active, e.line_no,
    p_name || ' ' || lower(p_type) || ' PN' || (part_key // 10 + 1000) AS title_normalized,
    CASE WHEN part_key % 17 <> 0 THEN lower(replace(p_brand, '#', '')) END AS brand,
    CASE WHEN part_key % 7 <> 0 THEN 'PN' || (part_key // 10 + 1000) END AS part_number,
    CASE WHEN part_key % 23 <> 0 THEN lower(p_type) END AS part_type,
    CAST(1 + CASE WHEN part_key % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pack_quantity,
    CASE WHEN line_no <> 2 THEN 'https://img.example/' || CASE WHEN line_no = 3 THEN 'logo-' ELSE '' END || part_key || '.jpg' END AS image_url,
    'https://www.' || seller_key || '.example/p/' || external_key AS url,
    CASE WHEN part_key % 4 = 0 THEN ['fits Nation ' || (part_key % 25),
        (['africa', 'america', 'asia', 'europe', 'middle east'])[part_key % 5 + 1]]
      ELSE ['fits Nation ' || (part_key % 25)] END AS vehicle_hints,
    CASE WHEN supp_key % 11 = 0 THEN ['not nation ' || (part_key % 25)] ELSE [] END AS vehicle_hints_excluded,
    supp_key % 13 = 0 AS overbroad_claim
  FROM price_events e JOIN part ON part_key = p_partkey""",
    ),
    "offers": (
        "offer_events",
        """
  SELECT * FROM offer_events
  QUALIFY row_number() OVER (PARTITION BY offer_uid ORDER BY occurred_at DESC, event_id DESC) = 1""",
    ),
    "active_offers": ("offers", "SELECT * FROM offers WHERE is_active"),
    "price_state": (
        "price_events",
        """
  SELECT * FROM price_events
  QUALIFY row_number() OVER (PARTITION BY offer_uid ORDER BY occurred_at DESC, event_id DESC) = 1""",
    ),
    "sellers": (
        "",
        """
  SELECT 's' || s_suppkey AS seller_key, s_name AS name, s_suppkey % 3 = 0 AS is_panel,
    CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 20 END AS domain_age_days,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST((s_suppkey % 10) / 10.0 AS DOUBLE) END AS contact_completeness,
    CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 2 = 0 END AS has_trust_badge,
    CASE WHEN s_suppkey % 25 = 24 THEN 'suspended' ELSE 'new' END AS tier,
    CASE WHEN s_suppkey = 50 THEN 'standard' END AS tier_override
  FROM supplier""",
    ),
    "vehicles": (
        "",
        """
  SELECT 'nation-' || n_nationkey AS vehicle_slug, r_name AS brand, r_name AS model, n_name AS trim,
    CAST(1990 + n_nationkey AS BIGINT) AS year_from,
    CASE WHEN n_nationkey % 4 <> 0 THEN CAST(2000 + n_nationkey AS BIGINT) END AS year_to,
    'Nation ' || n_nationkey AS display_name, [lower(n_name)] AS aliases
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'model-' || replace(lower(r_name), ' ', '-'), r_name, r_name, NULL, CAST(1990 AS BIGINT), NULL, r_name, [lower(r_name)]
  FROM region""",
    ),
    "clicks": (
        "",
        """
  SELECT event_id AS click_id, ts AS occurred_at, 'p' || (user_id % 50) AS product_uid,
    substr(sha256('s' || (user_id % 10) || ':p' || (user_id % 50)), 1, 32) AS offer_uid,
    's' || (user_id % 10) AS seller_key, '10.0.0.' || user_id AS ip_address,
    CASE WHEN event_id % 29 = 0 THEN 'Googlebot/2.1' ELSE 'agent/' || (user_id % 7) END AS user_agent,
    CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'https://other.example/x?q=1'
         WHEN event_id % 2 = 0 THEN 'https://m.shop.example:8443/p/1' ELSE 'https://shop.example/p/1' END AS referer,
    CASE WHEN event_id % 19 <> 0 THEN CAST(floor(value * 10000) AS BIGINT) END AS price_toman,
    event_id % 3 <> 0 AS is_panel_offer
  FROM events WHERE event_type = 'click'""",
    ),
    "topups": (
        "",
        """
  SELECT * FROM (SELECT CAST(event_id AS VARCHAR) AS reference, event_id AS topup_id, ts AS occurred_at,
    's' || (user_id % 10) AS seller_key, CAST(floor(value * 100) AS BIGINT) AS amount_toman
  FROM events WHERE event_type = 'purchase') WHERE amount_toman > 0""",
    ),
    "rate_card": (
        "",
        """
  SELECT * FROM (VALUES
    ('low', 0, 400000, 500, true, TIMESTAMP '2023-01-01', TIMESTAMP '2024-01-15'),
    ('low2', 0, 400000, 700, true, TIMESTAMP '2024-01-10', NULL),
    ('mid', 400000, 1500000, 1500, true, TIMESTAMP '2023-01-01', NULL),
    ('high', 1500000, NULL, 3000, true, TIMESTAMP '2024-01-05', NULL),
    ('old', 0, NULL, 9000, false, TIMESTAMP '2023-01-01', NULL))
  AS t(name, min_price_toman, max_price_toman, cost_toman, active, effective_from, effective_to)""",
    ),
}


def add_view(name: str, deps: str, body: str) -> None:
    VIEWS[name] = (deps, body)


def with_views(names: Sequence[str], body: str) -> str:
    """``WITH`` prefix holding the named views and what they read, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0].split():
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    body = body.strip()
    return f"WITH RECURSIVE {ctes}\nSELECT * FROM (\n{body}\n) AS result" if ctes else body

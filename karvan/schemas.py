"""Topic schemas (Spark DDL) and contract rules. Reading never infers a schema."""

from __future__ import annotations

ENVELOPE = (
    "event_id STRING, event_type STRING, version INT, occurred_at TIMESTAMP, producer STRING, trace_id STRING"
)

# fixed values: payload per topic
PAYLOADS = {
    "listings.observed": (
        "source_key STRING, external_key STRING, url STRING, raw_title STRING, raw_price_text STRING, "
        "raw_stock_text STRING, image_url STRING, raw_fragment STRING, archive_uri STRING, "
        "fragment_hash STRING, observed_at TIMESTAMP"
    ),
    "offers.enriched": (
        "offer_uid STRING, source_key STRING, external_key STRING, seller_key STRING, url STRING, "
        "raw_title STRING, title_normalized STRING, brand STRING, part_number STRING, part_type STRING, "
        "authenticity_claim STRING, pack_quantity INT, price_toman BIGINT, stock_status STRING, "
        "image_url STRING, vehicle_hints ARRAY<STRING>, vehicle_hints_excluded ARRAY<STRING>, "
        "overbroad_claim BOOLEAN, confidences MAP<STRING,DOUBLE>, extraction_provenance MAP<STRING,STRING>, "
        "normalizer_version STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, is_active BOOLEAN"
    ),
    "offers.fitted": (
        "offer_uid STRING, fitments ARRAY<STRUCT<vehicle_slug:STRING,status:STRING,confidence:DOUBLE,"
        "provenance:STRING,evidence:STRING>>, crossref_codes ARRAY<STRING>, "
        "risky_family STRUCT<part_type:STRING,required_granularity:STRING,note_fa:STRING>, computed_at TIMESTAMP"
    ),
    "vehicles.changed": (
        "vehicle_slug STRING, brand STRING, model STRING, trim STRING, year_from INT, year_to INT, "
        "engine_code STRING, display_name_fa STRING, aliases ARRAY<STRING>, is_published BOOLEAN, updated_at TIMESTAMP"
    ),
    "crossrefs.changed": (
        "code_a STRING, code_b STRING, brand_a STRING, brand_b STRING, confidence DOUBLE, "
        "provenance STRING, updated_at TIMESTAMP"
    ),
    "clusters.changed": (
        "cluster_uid STRING, members ARRAY<STRUCT<offer_uid:STRING,confidence:DOUBLE,provenance:STRING>>, "
        "change_reason STRING, predecessor_uids ARRAY<STRING>, successor_uid STRING, computed_at TIMESTAMP"
    ),
    "sellers.changed": (
        "seller_key STRING, name STRING, domain STRING, source_key STRING, is_panel BOOLEAN, tier STRING, "
        "trust_score DOUBLE, price_accuracy DOUBLE, stock_accuracy DOUBLE, updated_at TIMESTAMP"
    ),
    "clicks.recorded": (
        "click_id STRING, product_uid STRING, offer_uid STRING, seller_key STRING, cost_toman BIGINT, "
        "is_suspicious BOOLEAN, occurred_at TIMESTAMP"
    ),
    "seller_billing.changed": (
        "seller_key STRING, panel_offers_active BOOLEAN, suspension_reason STRING, updated_at TIMESTAMP"
    ),
    "review.requested": (
        "request_uid STRING, kind STRING, priority INT, subject STRING, evidence STRING, requested_at TIMESTAMP"
    ),
    "review.decided": (
        "request_uid STRING, kind STRING, decision STRING, subject STRING, actor STRING, reason STRING, "
        "decided_at TIMESTAMP"
    ),
}

# fixed values: controlled vocabularies
AUTHENTICITY = ("genuine", "oem", "aftermarket", "used", "refurbished", "unknown")
FITMENT = ("compatible", "incompatible", "unknown")
STOCK = ("in_stock", "out_of_stock", "unknown")
PROVENANCE = ("rule", "model", "human", "catalog", "consensus")
TIERS = ("new", "standard", "trusted", "suspended")


def envelope(topic: str) -> str:
    """DDL of a whole message of ``topic``."""
    payload = ", ".join(
        part.strip().replace(" ", ": ", 1) for part in _split_top_level(PAYLOADS[topic])
    )
    return f"{ENVELOPE}, payload STRUCT<{payload}>"


def _split_top_level(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]

"""Every threshold and weight in one place; operators take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RankingParams:
    # fixed values
    price_weight: float = 0.20
    stock_weight: float = 0.15
    freshness_weight: float = 0.05
    trust_band: float = 0.05
    halflife_days: float = 7.0


@dataclass(frozen=True)
class RepresentativeParams:
    # fixed values
    completeness: float = 0.50
    seller_trust: float = 0.25
    image: float = 0.20
    title_band: float = 0.05
    title_min: int = 12
    title_max: int = 90


@dataclass(frozen=True)
class TrustParams:
    # fixed values
    price_accuracy: float = 0.40
    stock_accuracy: float = 0.30
    panel: float = 0.10
    domain_age: float = 0.08
    contact: float = 0.07
    badge: float = 0.05
    prior: float = 0.5
    smoothing: float = 5.0
    min_observations: int = 10
    trusted_observations: int = 50
    trusted_threshold: float = 0.90
    ceilings: dict = field(
        default_factory=lambda: {"new": 0.45, "standard": 0.80, "trusted": 1.00, "suspended": 0.15}
    )


@dataclass(frozen=True)
class FraudParams:
    # fixed values
    ip_limit: int = 10
    ip_window_s: int = 300
    fingerprint_s: int = 1800
    velocity_limit: int = 200
    velocity_window_s: int = 300
    nonce_ttl_s: int = 1800


@dataclass(frozen=True)
class MatchParams:
    # Only the shape of the ladder is published; the levels are tunable.
    high: float = 0.80
    low: float = 0.45
    judge_confidence: float = 0.70
    price_range_factor: float = 2.5
    null_brand_high: float = 0.95
    title_similarity: float = 0.5


@dataclass(frozen=True)
class SearchParams:
    # fixed values
    title_weight: int = 8
    variants_weight: int = 5
    brand_weight: int = 3
    synonyms_weight: int = 4
    rrf_k: int = 60
    candidate_limit: int = 250
    result_floor: int = 5


PRICE_SERIES_DAYS = 90
RELATED_LIMIT = 8
COVERAGE_MIN_OFFERS = 200
COVERAGE_RATIO = 0.70
DEBOUNCE_SECONDS = 60
FRAGMENT_MAX_BYTES = 65536
NON_PANEL_TRUST_CAP = 0.65
DEAD_LETTER_RAW_CHARS = 8192

#: A key holding more rows than this is split by time (or sort-key) chunk
#: before any ordered per-key work, see ``operators.skew``.
HOT_KEY_ROWS = 1_000_000

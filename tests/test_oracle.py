"""Registered queries against DuckDB on the smallest tables.

The default list touches every module and stays quick; ``KARVAN_ORACLE=all`` runs
every key (``python tests/compare.py DIR`` does the same with timings).
"""

import os

import pytest
from compare import compare, duck

from karvan.plans import load_all
from karvan.plans.registry import QUERIES, oracles

load_all()
SF = "/root/testdata/sf0.001"
QUICK = """exact_dedupe latest_state cdc_fragment price_change_points debounced_emission price_stats daily_price_series
trust_score rank_offers cheapest_badge successor_chain elect_representative related_products landing_hubs sitemap_shards
normalize_text slugify urljoin_host extract_brand extract_part_number synonym_mining consensus_verdict conflict_reviews
coverage_gate block_part_number stable_cluster_uid cluster_change_events lexical_match suggest fraud_reasons
wallet_charge seller_click_stats crawl_tiers adapter_health archive_dedupe review_queue pipeline_health read_topic
contract_split read_csv_feed read_xml_feed seed_upsert stream_read_model stream_rate_limit""".split()
KEYS = sorted(QUERIES) if os.environ.get("KARVAN_ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", KEYS)
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], oracles().get(name)) == ""

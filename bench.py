"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and, for a
partial run, ``BENCH_KEYS`` (comma separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

from karvan.plans import load_all
from karvan.plans.registry import QUERIES
from karvan.session import local_session

HEADLINE = (
    "latest_state exact_dedupe cdc_fragment price_change_points material_change price_stats daily_price_series "
    "trust_score rank_offers cheapest_badge elect_representative related_products consensus_verdict offer_fitments "
    "fitment_rollup coverage_gate extract_brand extract_part_number normalize_text block_composite decision_ladder "
    "connected_components search_documents lexical_match fraud_reasons wallet_charge seller_click_stats crawl_tiers"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_KEYS", ",".join(HEADLINE)).split(",")
    load_all()
    spark = local_session(cpus, int(cpus) * 2)
    QUERIES["price_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

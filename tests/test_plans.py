"""Plans we rely on: no all-pairs joins, filters at the scan, no clicks in ranking."""

import pytest

from karvan.operators import matching, ranking
from karvan.plans import load_all, q_matching, q_ranking
from karvan.plans.registry import QUERIES

load_all()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["rank_offers", "price_change_points", "trust_score", "daily_price_series", "claim_table", "consensus_verdict", "related_products", "cpc_rate_lookup", "crossref_from_consensus", "block_composite", "block_title_similarity", "suggest"],
)
def test_no_all_pairs_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_replay_filter_reaches_the_scan(spark):
    text = plan(QUERIES["archive_dedupe"](spark, SF))
    assert "ReadSchema: struct<" in text
    text = plan(QUERIES["zero_result_report"](spark, SF))
    assert "EqualTo(event_type,view)" in text


def test_price_scan_is_narrow(spark):
    text = plan(QUERIES["price_stats"](spark, SF))
    assert "l_discount" not in text and "l_tax" not in text


def test_ranking_reads_no_clicks(spark):
    frame = ranking.rank_offers(q_ranking.rankable(spark, SF), q_ranking.v.as_of())
    assert "events.parquet" not in plan(frame)


def test_brand_wall_holds(spark):
    merged = matching.decision_ladder(q_matching.features(spark, SF)).where("decision = 'merge'")
    assert merged.where("a_brand <> b_brand").isEmpty()


def test_no_brand_in_two_clusters(spark):
    rows = [("c1", "x"), ("c1", "x"), ("c2", "x"), ("c2", None), ("c3", "x"), ("c3", "y")]
    df = spark.createDataFrame(rows, "cluster_uid string, brand string")
    assert [r["cluster_uid"] for r in matching.brand_wall_violations(df).collect()] == ["c3"]


def test_sellers_are_joined_without_a_hint(spark):
    from karvan.plans import q_catalog

    for frame in (q_ranking.rankable(spark, SF), q_catalog.members(spark, SF)):
        assert "Hint" not in frame._jdf.queryExecution().analyzed().toString()

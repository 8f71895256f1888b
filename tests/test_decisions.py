"""Decisions, dead letters and redirects that are not as they should be."""

import datetime as dt

from karvan.operators import catalog, fitment
from karvan.sources import topics


def test_unusable_approvals_are_dead_letters_and_settle_nothing(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [
        ("P1", "v1", "approve", "compatible", at(1), "r1"),
        ("P1", "v1", "approve", "maybe", at(2), "r2"),
        ("P2", "v1", "approve", "incompatible", at(1), "r3"),
        ("P2", "v1", None, None, at(2), "r4"),
        ("P3", "v9", "approve", "compatible", at(1), "r5"),
        (None, "v1", "approve", "compatible", at(1), "r6"),
        ("P4", None, "approve", "unknown", at(1), "r7"),
        ("P5", "v1", "skip", None, at(1), "r8"),
        ("P6", "v1", "approve", None, at(1), "r9"),
    ]
    decisions = spark.createDataFrame(rows, "part_number string, vehicle_slug string, decision string, status string, decided_at timestamp, request_uid string")
    vehicles = spark.createDataFrame([("v1",), ("v1",), ("v2",)], "vehicle_slug string")
    settled = fitment.latest_corrections(decisions, vehicles).collect()
    assert [(r.part_number, r.human_status, r.request_uid) for r in settled] == [("P1", "compatible", "r1")]
    assert {r.part_number for r in fitment.latest_corrections(decisions).collect()} == {"P1", "P3"}
    dead = {r.request_uid: r.reason for r in fitment.invalid_decisions(decisions, vehicles).collect()}
    assert dead == {"r2": "unusable_verdict", "r5": "unknown_vehicle", "r6": "no_part_number", "r7": "unknown_vehicle", "r9": "unusable_verdict"}


def test_letters_that_cannot_be_read_are_kept(spark):
    dead = spark.createDataFrame([("offers.enriched", "{broken"), ("offers.enriched", "{}"), ("other", "{broken")], "topic string, message string")
    handled = spark.createDataFrame([], "event_id string")
    retried, unreadable = topics.dlq_retry(dead, handled, "offers.enriched")
    assert retried.count() == 0 and unreadable.count() == 2


def test_cycles_of_successors_have_no_end(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("in", "x"), ("me", "me")]
    got = {r.uid: r.final for r in catalog.successor_chain(spark.createDataFrame(rows, "uid string, successor string")).collect()}
    assert got == {"a": "c", "b": "c", "x": None, "y": None, "in": None, "me": None}


def test_a_message_is_parsed_once(spark):
    from karvan.plans import q_sources

    rows = topics.read_topic(q_sources.offer_messages(spark, "/root/testdata/sf0.001"), "offers.enriched").where("NOT is_corrupt AND NOT is_tombstone")
    text = rows.select("event_id", "payload.stock_status").where("stock_status = 'sold'")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(") == 1

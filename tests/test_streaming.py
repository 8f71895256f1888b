"""Streams whose events come late or twice."""

from datetime import datetime

from pyspark.sql import functions as F

from karvan.plans import q_search, q_streaming
from karvan.streaming import jobs

TIMES = {"a": datetime(2024, 6, 1), "b": datetime(2024, 7, 20), "late": datetime(2023, 1, 1), "c": datetime(2024, 7, 21)}


def test_dedupe_keeps_late_events(spark, tmp_path):
    batches = ["aab", "bc", ["late", "a", None], ["late", "c", None]]
    for batch_id, ids in [*enumerate(batches), (3, batches[3])]:  # the last batch is retried
        rows = [(i, TIMES.get(i)) for i in ids]
        df = spark.createDataFrame(rows, "event_id string, occurred_at timestamp")
        jobs.dedupe_table(str(tmp_path / "out"), ["event_id"], "event_id STRING")(df, batch_id)
    got = jobs.read_batches(spark, str(tmp_path / "out"), "event_id STRING").select("event_id", "batch_id").collect()
    assert {r.event_id: r.batch_id for r in got} == {"a": 0, "b": 0, "c": 1, "late": 2, None: 2} and len(got) == 5


def test_dedupe_query_runs_on_real_times(spark, monkeypatch):
    """Files in order of arrival: the late event comes once the stream is 18 months ahead."""
    seen = []
    run = jobs.run_available

    def spy(stream, handle, *rest):
        run(stream, lambda df, i: (seen.extend(r.occurred_at for r in df.collect() if "occurred_at" in df.columns), handle(df, i)), *rest)

    def events(spark, d):
        path = q_streaming.scratch(spark, "late")
        for i in ("a", "b", "late", "c", "late", "b"):
            row = spark.createDataFrame([(i, TIMES[i])], "event_id string, occurred_at timestamp")
            row.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema("event_id STRING, occurred_at TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(path)

    monkeypatch.setattr(jobs, "run_available", spy)
    monkeypatch.setattr(q_streaming, "event_stream", events)
    out = q_streaming.stream_exact_dedupe(spark, "")
    assert sorted(r.event_id for r in out.collect()) == ["a", "b", "c", "late"]
    assert set(seen) == set(TIMES.values()) and out.where(F.col("event_id").isNull()).isEmpty()


def test_reindex_all_keeps_every_field(spark, monkeypatch):
    """What offers, codes, vehicles and synonyms gave a document stands in the rebuilt table."""
    fields = {
        "product_uid": "p1", "title": "spare x", "brand": "b", "part_type": "x", "authenticity_dominant": "genuine", "has_image": True, "offer_count": 2,
        "min_price_toman": 50, "title_variants": ["t1", "t2"], "vehicles_compatible": ["v1", "v2"], "vehicles_incompatible": ["v3"], "part_numbers": ["A", "B"],
        "part_type_synonyms": ["s"], "price_freshness": 7, "best_seller_trust": 0.25,
    }
    monkeypatch.setattr(q_search, "documents", lambda spark, d: spark.createDataFrame([fields]))
    row = q_streaming.reindex_all(spark, "").first().asDict()
    want = fields | {"variants": "t1|t2", "vehicles_compatible": "v1,v2", "vehicles_incompatible": "v3", "part_numbers": "A,B", "synonyms": "s", "codes": 2}
    assert row == {k: v for k, v in want.items() if k not in ("title_variants", "part_type_synonyms")}

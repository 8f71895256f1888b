"""The pipeline on the smallest tables: every stage's decision takes effect."""

import corpus_pipeline
from test_dedup import _cut_brute

from karvan.llm.common import read, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup"):
            assert 0 < len(out) <= len(rows) and {r.doc_id for r in out} <= {r.doc_id for r in rows}
        if name == "substring_dedup":
            want = _cut_brute([(r.doc_id, r.text or "", "") for r in rows])
            assert {r.doc_id: len(r.text.split(" ")) if r.text else 0 for r in out if want[r.doc_id][1]} == {i: n - gone for i, (n, gone, _) in want.items() if gone}
        if name == "mixing":
            before = {r.doc_id: r.text for r in out}
        if name == "sentencepiece":
            assert {r.doc_id for r in out} == set(before) and all(r.round_trip for r in out)


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "ids" in out.columns and out.count() > 0

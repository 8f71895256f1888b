"""The mix against its definition."""

import random

from pyspark.sql import functions as F

from karvan.llm.common import word_count
from karvan.llm.mixing import MAX_PASSES, WEIGHTS, curriculum, plan_mix


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > MAX_PASSES * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(MAX_PASSES * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_takes(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(("b", "a", "a", "a", "Z", None, "é"))) for i in range(400)]
    docs = documents(rows).withColumn("size", word_count(F.col("text")))
    out = plan_mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = _targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.passes * r.size <= MAX_PASSES * r.size
        assert (r.first_position is None) == (r.passes == 0) and (r.first_position is None or 0 <= r.first_position <= 1)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    again = {(r.doc_id, r.taken, r.first_position) for r in plan_mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken, r.first_position) for r in out}


def test_curriculum_repeats_documents_in_order(documents):
    rows = [(i, " ".join(["w"] * 10), "abc"[i % 3]) for i in range(90)]
    docs = documents(rows)
    out = curriculum(docs)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    assert len(got) == 90 and len(set(got)) < 90


def test_odd_inputs(odd_documents, documents):
    out = plan_mix(odd_documents.withColumn("size", word_count(F.col("text")))).collect()
    assert len(out) == 12 and all(r.taken == 0 for r in out if r.size == 0)
    assert curriculum(odd_documents).count() > 0
    empty = documents([])
    assert plan_mix(empty.withColumn("size", word_count(F.col("text")))).count() == 0 and curriculum(empty).count() == 0

"""Vector classes and searches against brute force."""

import numpy as np
import pytest

from karvan.llm import embedding_dedup
from karvan.llm.embedding_dedup import embedding_classes
from karvan.llm.topk import top_products, usable_integers

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows():
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for label, groups in ((0, (300, 40, 1, 1, 1)), (1, (2, 1, 1)), (7, (1,))):
        for n in groups:
            center = rng.normal(size=16)
            for _ in range(n):
                v = center + 0.04 * rng.normal(size=16) if n > 1 else center
                rows.append((i, [float(np.float32(x)) for x in v], label))
                i += 1
    same = rows[0][1]
    odd = [(i, same, 0), (i + 1, same, 1), (i + 2, None, 0), (i + 3, [0.0] * 16, 0), (i + 4, [float("nan")] + same[1:], 0), (i + 5, [None] + same[1:], 0), (i + 6, same, None), (i + 7, [], 1)]
    return rows + odd


def _brute(rows):
    n = {i: 0 for i, *_ in rows}
    parent = {i: i for i in n}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for a, va, la in good:
        for b, vb, lb in good:
            if a < b and la == lb and va @ vb / np.sqrt(va @ va) / np.sqrt(vb @ vb) >= 0.98:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in n}


@pytest.mark.parametrize("shard", [16_384, 100])
def test_classes_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    rows = _rows()
    out = embedding_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == _brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embedding_classes(spark.createDataFrame([], SCHEMA)).count() == 0


class _Narrow:
    """A graph whose first beam meets only a query's own row, unless the query is in the crowd."""

    def __init__(self, x, crowd):
        self.x, self.crowd, self.beams = embedding_dedup._unit(x), crowd, []

    def search(self, q, beam):
        self.beams.append(beam)
        sims = q @ self.x.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        best = np.take_along_axis(sims, order, 1)
        if beam <= embedding_dedup.BEAM:
            alone = order[:, 0] >= self.crowd
            order[alone, 1:], best[alone, 1:] = -1, -np.inf
        return order, best


def _linked(graph, x):
    got = embedding_dedup._links(graph, x, x, np.arange(len(x)), 0.98)
    unit = embedding_dedup._unit(x).astype(np.float64)
    return [set(rows.tolist()) for rows in got], [set(np.flatnonzero(row >= 0.98).tolist()) for row in unit @ unit.T]


@pytest.mark.parametrize("widest", [1.0, 1 / 128])
def test_crowd_does_not_hide_lost_pairs(monkeypatch, widest):
    monkeypatch.setattr(embedding_dedup, "WIDEST", widest, raising=False)
    rng = np.random.default_rng(2)
    crowd = rng.normal(size=32) + 0.01 * rng.normal(size=(2000, 32))
    pairs = np.repeat(rng.normal(size=(1000, 32)), 2, axis=0)
    x = np.concatenate([crowd, pairs + 0.01 * rng.normal(size=pairs.shape)]).astype(np.float32)
    graph = _Narrow(x, len(crowd))
    got, want = _linked(graph, x)
    assert got == want and (96 in graph.beams) == (widest == 1)


def test_rare_links_are_audited():
    x = np.random.default_rng(3).normal(size=(3200, 32)).astype(np.float32)
    asked = set(np.random.default_rng(len(x)).permutation(len(x))[: embedding_dedup.AUDIT].tolist())
    a, b = [i for i in range(len(x)) if i not in asked][:2]  # the one pair is not in a uniform sample
    x[b] = x[a]
    got, want = _linked(_Narrow(x, 0), x)
    assert got == want and got[a] == {a, b}


def test_top_products_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice((0.1, 1, 5))]) for i in range(900)]
    vectors += [(900, vectors[20][1]), (901, None), (902, [float("inf")] * 8), (1000, vectors[20][1])]
    q = {i: np.floor(64 * np.array(v, float)).astype(np.int64) for i, v in vectors if v and np.isfinite(v).all()}
    want = {}
    for i in (i for i in q if i % 20 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
        want[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(best)]
    frame = usable_integers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = {}
    for r in top_products(frame, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == want
    few = usable_integers(spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>"))
    assert top_products(few, "vec_id % 20 = 0").count() == 2
    assert top_products(few.limit(0), "vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("large", [4e7, 1e8, 1e12])
def test_large_components_and_lengths(spark, large):
    rng = np.random.default_rng(int(large) % 97)
    vectors = [(i, [float(x) for x in rng.choice((1.0, -2.0, 0.5, large, -large), size=rng.integers(1, 5))]) for i in range(120)]
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    want = {}
    for i in range(0, 120, 20):
        scores = [(max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(q[i], q[j], strict=False)))), j) for j in q if j != i]
        want[i] = [(r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:20])]
    got = {}
    for r in top_products(usable_integers(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == want

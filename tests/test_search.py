"""Index search and text matching against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from karvan.operators import ivf, search


def _data(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    x = np.round((centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dims))) * 8)
    x[5] = x[6] = x[7]
    return x


def _exact(x, q, k, ok):
    dots = x @ q
    with np.errstate(invalid="ignore"):
        sims = dots / np.sqrt((q @ q) * (x * x).sum(1))
    good = [i for i in range(len(x)) if ok(i) and np.isfinite(sims[i])]
    return [(i, sims[i]) for i in sorted(good, key=lambda i: (-sims[i], i))[:k]]


@pytest.fixture(scope="module")
def cloud(spark):
    x = _data(3000, 16, 1)
    x[9] = 0
    rows = [(i, [float(c) for c in v], int(i % 50)) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [float("nan")] * 16, 1), (5002, [1.0, 2.0], 1), (5003, [], 1)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, kind int")
    return x, ivf.build_index(frame)


def _ask(spark, x, index, exact, nearest=4):
    def admits(asked, rows):  # inside, so that it travels by value
        return np.ones(len(rows), bool) if pd.isna(asked["wanted"]) else (rows["kind"] == asked["wanted"]).to_numpy()

    asked = [(f"q{i}", [float(c) for c in x[i * 7] + 1], (None, 3, 999)[i % 3]) for i in range(60)]
    asked += [("zero", [0.0] * 16, None), ("short", [1.0], None)]
    frame = spark.createDataFrame(asked, "query_id string, embedding array<double>, wanted int")
    got = {}
    for r in ivf.search_index(index, frame, 10, admits, nearest=nearest, exact=exact).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    want = {}
    for i in range(60):
        kind = (None, 3, 999)[i % 3]
        if found := _exact(x, x[i * 7] + 1, 10, lambda j, kind=kind: kind is None or j % 50 == kind):
            want[f"q{i}"] = found
    return got, want


def test_index_search_is_exact(spark, cloud):
    x, index = cloud
    assert len(index.centroids) > 10
    got, want = _ask(spark, x, index, True)
    assert got == want


def test_approximate_search_reaches_its_recall_and_widens_behind_filters(spark, cloud):
    x, index = cloud
    got, want = _ask(spark, x, index, False)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert ivf.build_index(none) is None
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert ivf.search_index(None, asked, 3).count() == 0


def test_long_lists_are_cut_into_pieces(spark):
    rows = spark.range(5000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    index = ivf.build_index(rows)
    assert index.rows.groupBy("list", "piece").count().agg(F.max("count")).first()[0] < 2 * ivf.PIECE
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert [r.id for r in ivf.search_index(index, asked, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_filters_agree_with_the_column_expression(spark):
    docs = [("a", "b1", "t", "genuine", 5, True, ["v1"]), ("b", None, "t", None, None, False, []), ("c", "b1", None, "x", 9, None, None)]
    names = "product_uid string, brand string, part_type string, authenticity_dominant string, min_price_toman long, has_image boolean, vehicles_incompatible array<string>"
    asked = [(1, None, None, None, None, None, None, None), (2, "b1", None, None, 6, None, None, None), (3, None, "t", "genuine", None, 5, True, "v1"), (4, None, None, None, None, None, False, "v2")]
    frame = spark.createDataFrame(asked, "query_id long, f_brand string, f_part_type string, f_authenticity string, f_min_price long, f_max_price long, f_has_image boolean, vehicle string")
    documents = spark.createDataFrame(docs, names)
    want = {(r.query_id, r.product_uid) for r in frame.crossJoin(documents).where(search.passes_filters(F.col("vehicle"))).collect()}
    rows = documents.toPandas()
    got = {(q.query_id, u) for _, q in frame.toPandas().iterrows() for u in rows["product_uid"][search.admits(q, rows)]}
    # a missing list of vehicles bars nothing in the index; the column expression leaves such rows out
    assert got - {(4, "c")} == want - {(4, "c")} and len(want) > 3
    counts = {r.query_id: r.passing for r in search.passing_documents(frame.withColumnRenamed("vehicle", "vehicle_slug"), documents.where("vehicles_incompatible IS NOT NULL")).collect()}
    assert counts == {q: n for q in (1, 2, 3, 4) if (n := len([w for w in want if w[0] == q and w[1] != "c"]))}


def test_texts_match_like_all_postings(spark):
    index = [("spare", "p1", 8), ("model5", "p1", 8), ("spare", "p2", 5), ("model4", "p2", 8), ("oil", "p3", 3), ("oils", "p3", 8), ("spare", "p3", 4)]
    frame = spark.createDataFrame(index, "token string, product_uid string, weight int")
    texts = ["spare model5", "spar", "oil spare", "oil", "oilx", "spare spare", "nothing spare", "", "model5 model4"]
    asked = spark.createDataFrame([(i, t.upper()) for i, t in enumerate(texts)], "query_id long, text string")
    got = {(r.query_id, r.product_uid): r.lexical_score for r in search.lexical_match(asked, frame).collect()}
    near = lambda a, b: a == b or len(a) >= 4 and sum(1 for _ in filter(lambda z: z[0] != z[1], zip(a, b, strict=False))) + abs(len(a) - len(b)) <= 1
    want = {}
    for i, t in enumerate(texts):
        words = set(t.split())
        for p in ("p1", "p2", "p3"):
            best = [max([w * (1.0 if a == tok else 0.5) for tok, u, w in index if u == p and near(a, tok)], default=0) for a in words]
            if words and min(best) > 0:
                want[i, p] = sum(best)
    assert got == want and len(want) > 5


def test_searches_of_one_vector_share_a_row(spark, monkeypatch):
    """A vector is moved once for many searches of it, and the second pass brings only what reaches the threshold."""
    x = np.random.default_rng(3).integers(-9, 9, (400, 8)).astype(float)
    index = ivf.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"))
    asked = spark.createDataFrame([(f"q{i}", x[i % 3].tolist()) for i in range(90)], "query_id string, embedding array<double>")
    bundles = ivf._bundles(ivf.usable(asked).withColumn("threshold", F.lit(-2.0)))
    assert bundles.count() == 3 and sum(len(r.query_id) for r in bundles.collect()) == 90
    high = ivf._bundles(ivf.usable(asked).withColumn("threshold", F.lit(0.9)))
    types = {"query_id": "string", "id": "bigint"}
    near = ivf._scan(ivf._probe(high, index, 400, False), high, index, types, 400, None, None, 1).collect()
    assert near and all(r.similarity >= 0.9 - 1e-5 for r in near)
    best = ivf.search_index(index, asked, 5).collect()
    want = {i: [j for j, _ in _exact(x, x[i], 5, lambda j: True)] for i in range(3)}
    for i in range(90):
        got = [r.id for r in sorted((r for r in best if r.query_id == f"q{i}"), key=lambda r: r.rank)]
        assert got == want[i % 3]

import random

import numpy as np
from pyspark.sql import functions as F

from karvan.operators import graph, matching, search


def union_find(edges, walls=()):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted({n for a, b, *_ in edges for n in (a, b)})
    parent.update({n: n for n in nodes})
    for a, b, *_ in edges:
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        if any({find(x), find(y)} == {ra, rb} for x, y in walls if x in parent and y in parent):
            continue
        parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(sorted(g) for g in groups.values())


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    return sorted(sorted(g) for g in groups.values())


def random_edges(seed, nodes=40, edges=45):
    rng = random.Random(seed)
    out = set()
    while len(out) < edges:
        a, b = rng.sample(range(nodes), 2)
        out.add((f"n{min(a, b):02d}", f"n{max(a, b):02d}"))
    return sorted(out)


def test_connected_components(spark):
    edges = random_edges(1) + [("hub", f"x{i}") for i in range(30)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    df = spark.createDataFrame(edges, "a string, b string")
    assert grouped(graph.connected_components(df)) == union_find(edges)


def test_constrained_components(spark):
    edges = random_edges(7)
    df = spark.createDataFrame(edges, "a string, b string").withColumn("score", F.pmod(F.xxhash64("a", "b"), F.lit(10)) / 10.0)
    walls = [("n00", "n05"), ("n01", "n09"), ("n03", "n20"), ("n10", "n30"), ("n11", "n12")]
    wdf = spark.createDataFrame(walls, "a string, b string")
    scored = df.withColumn("tie", F.xxhash64("a", "b")).orderBy(F.desc("score"), F.desc("tie")).collect()
    want = union_find([(r["a"], r["b"]) for r in scored], walls)
    got = grouped(graph.constrained_components(df, wdf))
    assert got == want
    for group in got:
        assert not any(a in group and b in group for a, b in walls)


def test_similar_sets(spark):
    rng = random.Random(3)
    sets = [(rng.choice("AB"), f"i{i:02d}", [f"t{min(int(rng.expovariate(0.15)), 30)}" for _ in range(rng.randrange(1, 9))]) for i in range(60)]
    df = spark.createDataFrame(sets, "g string, item string, t array<string>")
    for threshold in (0.3, 0.5, 0.8):
        got = sorted((r["x"], r["y"]) for r in graph.pairs_of_similar_sets(df, ["g"], "item", "t", threshold).collect())
        want = []
        for ga, a, ta in sets:
            for gb, b, tb in sets:
                if ga == gb and a < b and len(set(ta) & set(tb)) / len(set(ta) | set(tb)) >= threshold:
                    want.append((a, b))
        assert got == sorted(want)


def test_embedding_channel_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 16))
    vecs = [(i, [float(x) for x in base[i % 20] + 0.05 * rng.standard_normal(16)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "id long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in matching.block_embedding(df, 16, 0.95).collect()}
    m = np.array([v for _, v in vecs])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if m[i] @ m[j] >= 0.95}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_leaves_are_set_aside(spark, monkeypatch):
    """Of a star only its centre could enter the rounds; loops, nulls and repeated edges change nothing."""
    seen = []
    rounds = graph._components_of_core
    monkeypatch.setattr(graph, "_components_of_core", lambda edges: (seen.append(edges.count()), rounds(edges))[1])
    star = [("a", f"b{i}") for i in range(20)] + [("b3", "a"), ("z", "z"), (None, "y"), ("m", "c"), ("c", "m")]
    chain = [("c", "d"), ("d", "e"), ("e", "f"), ("f", "b")]
    for edges, most in ((star, 0), (star + chain, 5)):
        df = spark.createDataFrame(edges, "a string, b string")
        rows = graph.connected_components(df).collect()
        known = [(x or y, y or x) for x, y in edges]
        named = [r for r in rows if r["node"] is not None]
        assert len(named) == len({x for e in known for x in e}) and len(rows) == len(named) + 1
        assert {r["component"] for r in named} == {min(g) for g in {r["component"]: [s["node"] for s in named if s["component"] == r["component"]] for r in named}.values()}
        linked = [e for e in known if e[0] != e[1]]
        assert {r["node"]: r["component"] for r in named if r["node"] not in ("z", "y")} == {n: min(g) for g in map(set, union_find(linked)) for n in g}
        assert seen[-1] <= most


def test_clusters_are_contracted(spark, monkeypatch):
    """Later rounds of the guarded merge see edges of clusters, not of nodes."""
    sizes = []
    best = graph._best_between

    def counted(edges):
        out = best(edges)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "_best_between", counted)
    rng = random.Random(9)
    edges = [(f"n{i:03d}", f"n{rng.randrange(i):03d}", rng.randrange(50) / 50.0) for i in range(1, 80)]
    walls = [("n000", "n001"), ("n002", "n003"), ("n005", "n004"), ("n007", "n007")]
    df = spark.createDataFrame(edges, "a string, b string, score double")
    tied = df.withColumn("tie", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).orderBy(F.desc("score"), F.desc("tie")).collect()
    out = graph.constrained_components(df, spark.createDataFrame(walls, "a string, b string"))
    assert grouped(out) == union_find([(r["a"], r["b"]) for r in tied], [w for w in walls if w[0] != w[1]])
    assert len(sizes) > 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]


def test_embedding_channel_finds_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((90, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[i % 5]) for i in range(12)]
    rows += [(3, vectors[3]), (4, vectors[60]), (300, [0.0] * 8), (301, None), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (None, vectors[0])]
    rows += [(304, [1.0, 2.0]), (305, [2.0, 4.0])]
    want = {}
    for a, x in rows:
        for b, y in rows:
            if None in (a, b) or a >= b or not x or not y or None in x + y or len(x) != len(y):
                continue
            x_, y_ = np.array(x), np.array(y)
            if (cosine := x_ @ y_ / max(1e-300, np.sqrt((x_ @ x_) * (y_ @ y_)))) >= 0.4:
                want[a, b] = max(cosine, want.get((a, b), -1))
    assert {(200, 205), (304, 305), (0, 200)} <= want.keys()
    monkeypatch.setattr(matching, "VECTOR_BLOCK", 16)
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, "id long, embedding array<double>").select("id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
        out = matching.block_embedding(df, 8, 0.4).collect()
        got = {(r["a"], r["b"]): r["cosine"] for r in out}
        assert len(got) == len(out) and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1])], "id string, embedding array<double>")
    assert [(r["a"], r["b"]) for r in matching.block_embedding(named, 2, 0.4).collect()] == [("a", "b")]
    assert matching.block_embedding(df.where("id < 0"), 8, 0.4).collect() == []


def test_typo_tokens(spark):
    words = ["brake", "brak", "brakes", "break", "pump", "bump", "lamp", "rbake"]
    vocab = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r["asked"], r["token"]) for r in search.typo_tokens(vocab, vocab).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    assert got == {(a, b) for a in words for b in words if distance(a, b) <= 1}


def test_hashed_embedding(spark):
    import hashlib

    texts = [(1, "Brake  Pad 206"), (2, "x"), (3, "brake pad 405")]
    df = spark.createDataFrame(texts, "id long, t string")
    got = {r["id"]: r["embedding"] for r in search.hashed_embedding(df, "id", "t", 64).collect()}
    for key, text in texts:
        clean = " ".join(text.lower().split())
        padded = f"  {clean}  "
        feats = [f"w:{w}" for w in clean.split()] + [f"c:{padded[i : i + 4]}" for i in range(len(padded) - 3)]
        v = np.zeros(64)
        for f in feats:
            h = hashlib.sha256(f.encode()).hexdigest()
            v[int(h[:8], 16) % 64] += 1.0 if int(h[9], 16) % 2 else -1.0
        assert np.allclose(got[key], v / np.linalg.norm(v), atol=1e-5)


def test_transitivity_guard_sees_every_wall(spark):
    """The registered query, against brute force over all walls of the smallest tables."""
    from karvan.plans import load_all, q_matching
    from karvan.plans.registry import QUERIES

    load_all()
    edges = q_matching.code_edges(spark, "/root/testdata/sf0.001").withColumn("score", F.pmod(F.xxhash64("a", "b"), F.lit(100)) / 100.0)
    scored = edges.withColumn("tie", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).orderBy(F.desc("score"), F.desc("tie")).collect()
    ends = {}
    for r in scored:
        ends.setdefault(r["a"], set()).add(r["b"])
    walls = [(min(x), max(x)) for x in ends.values() if len(x) > 1]
    assert len(walls) > 10
    assert grouped(QUERIES["transitivity_guard"](spark, "/root/testdata/sf0.001")) == union_find([(r["a"], r["b"]) for r in scored], walls)

"""The manifest against a tree built in one go."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from karvan.llm.merkle import FIELDS, Frontier, fold, leaf_hash, manifest, verify


def _h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(leaves, fanout=8):
    """Root and, per leaf, its siblings level by level."""
    level, member, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, node in enumerate(member):
            start = node // fanout * fanout
            paths[leaf] += [level[i] for i in range(start, min(start + fanout, len(level))) if i != node]
        level = [_h(level[i : i + fanout]) for i in range(0, len(level), fanout)]
        member = [m // fanout for m in member]
    return level[0], paths


def _whole(rows, fanout=8):
    """Rows of FIELDS -> sorted (doc_id, leaf, subroot, root, proof)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots = [], []
    for lang in langs:
        group = sorted([(r[0] is not None, r[0] or 0, _leaf(r)) for r in rows if r[2] == lang])
        root, paths = _tree([g[2] for g in group], fanout)
        subroots.append(root)
        out.append([(g[1] if g[0] else None, g[2], p) for g, p in zip(group, paths, strict=True)])
    top, upper = _tree(subroots, fanout)
    return sorted(
        ((i, leaf, sub, top, _h(path + up)) for group, sub, up in zip(out, subroots, upper, strict=True) for i, leaf, path in group),
        key=str,
    )


@pytest.mark.parametrize(("n", "fanout"), [(1, 8), (2, 8), (8, 8), (9, 8), (64, 8), (65, 2), (73, 3), (513, 8)])
def test_frontier_is_the_tree(n, fanout):
    leaves = [sha256(str(i).encode()).digest() for i in range(n)]
    levels = 0
    while fanout**levels < n:
        levels += 1
    frontier = Frontier(levels, fanout)
    for leaf in leaves:
        frontier.append(leaf)
    root, paths = _tree([x.hex() for x in leaves], fanout)
    assert frontier.close().hex() == root
    assert [w.hex() for w in frontier.witnesses] == ["".join(p) for p in paths]
    assert all(fold(x, bytes(w), ((i, n),), fanout).hex() == root for i, (x, w) in enumerate(zip(leaves, frontier.witnesses, strict=True)))


def _run(docs, fanout, height):
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf_hash([F.col(c) for c in FIELDS]).alias("digest"))
    return verify(manifest(leaves, ["doc_id"], fanout, height), "digest", fanout)


@pytest.mark.parametrize(("fanout", "height"), [(8, 4), (2, 2), (8, 1)])
def test_manifest_in_small_blocks(spark, fanout, height):
    rng = random.Random(fanout * 10 + height)
    langs = [None, "", "de", "en", "en", "en", "fr", "é", "zz", "a", "b"]
    rows = [(i, rng.choice((None, "", "Ärger", "text of it")), rng.choice(langs)) for i in rng.sample(range(10_000), 400)]
    rows += [(None, "x", "en"), (None, "y", "en"), (7, "same", "de"), (7, "same", "de"), (20_000, "alone", "alone")]
    langs_of = spark.createDataFrame([(n, lang) for n, (_, _, lang) in enumerate(rows)], "n long, lang string")
    numbered = spark.createDataFrame([(n, i, t, "s") for n, (i, t, _) in enumerate(rows)], "n long, doc_id long, text string, source string")
    full = numbered.join(langs_of, "n").withColumn("n_chars", F.length("text").cast("long")).withColumn("pos", F.lit("clash"))
    got = _run(full.repartition(5), fanout, height).collect()
    assert all(r.folded == r.root for r in got)
    want = _whole([(i, "s", lang, None if t is None else len(t), t) for i, t, lang in rows], fanout)
    mine = sorted(((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex()) for r in got), key=str)
    assert mine == want


def test_tampering_is_found_and_empty_tables(documents):
    docs = documents([(i, f"Text {i}", None) for i in range(50)])
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf_hash([F.col(c) for c in FIELDS]).alias("digest"))
    other = docs.withColumn("text", F.lower("text"))
    claims = other.select("doc_id", leaf_hash([F.col(c) for c in FIELDS]).alias("claimed"))
    out = verify(manifest(leaves.join(claims, "doc_id"), ["doc_id"]), "claimed").collect()
    assert len(out) == 50 and all(r.folded != r.root for r in out)
    empty = documents([])
    assert _run(empty, 8, 4).count() == 0

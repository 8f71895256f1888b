"""Embedding near-deduplication over small-world graphs.

Vectors with the same label are dealt into shards of bounded size; each shard gets a navigable
small-world graph. Every vector asks every shard of its label. A beam that is full of linked
vectors widens; an audit against brute force on a sample of each block of queries widens all
beams until every audited query passes by itself, and where that grows dearer than exact
products they take over. Every link is verified by its cosine in double precision, and the
components of the links are the classes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import written
from karvan.llm.hnsw import Graph
from karvan.operators.graph import connected_components

THRESHOLD = 0.98
#: Vectors in a shard, queries in a block; both fit a task.
SHARD, BLOCK = 16_384, 16_384
#: First beam; queries audited by brute force in each block and the recall asked of each of them.
BEAM, AUDIT, RECALL = 48, 128, 0.999
#: Beams of more than this share of a shard cost more than exact products, which take their place.
WIDEST = 1 / 128
INDEX = "label int, shard int, ids binary, rows binary, graph binary"
FOUND = "vec_id long, root long, n long"


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(table: pa.Table, name: str = "embedding") -> np.ndarray:
    return np.array(table[name].to_pylist(), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _build(table: pa.Table) -> pa.Table:
    """Shard -> its graph; rows in id order, so a repeated task builds the same one."""
    table = table.sort_by("vec_id")
    x = matrix(table)
    graph = Graph(_unit(x))
    row = {"label": [table["label"][0].as_py()], "shard": [table["shard"][0].as_py()], "ids": [table["vec_id"].to_numpy().tobytes() + table["copies"].to_numpy().tobytes()], "rows": [x.tobytes()], "graph": [pickle.dumps((graph.entry, graph.layers))]}
    return pa.table({k: pa.array(v, pa.int32() if k in ("label", "shard") else pa.binary()) for k, v in row.items()})


def _crowds(found: list[np.ndarray], full: list[int], own_row: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """Queries with full beams in groups that found a common row, with all rows a group found."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for i in full:
        for r in found[i].tolist():
            parent[root(r)] = root(int(found[i][0]))
    groups: dict[int, list[int]] = {}
    for i in full:
        groups.setdefault(root(int(found[i][0])), []).append(i)
    return [(own, np.unique(np.concatenate([own_row[own][own_row[own] >= 0], *(found[i] for i in own)]))) for own in groups.values()]


def _auditors(links: np.ndarray) -> np.ndarray:
    """Queries to audit, dealt evenly over the sizes of what they found: 0, 1-2, 3-6, 7-14, ... links."""
    order = np.random.default_rng(len(links)).permutation(len(links))
    size = np.log2(links[order] + 1).astype(int)
    by = np.argsort(size, kind="stable")
    first = np.searchsorted(size[by], size[by])
    return order[by][np.argsort(np.arange(len(by)) - first, kind="stable")][:AUDIT]


def _links(graph: Graph, x: np.ndarray, q: np.ndarray, own_row: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Rows of ``x`` linked with each query; ``own_row`` is a query's own row, -1 in another shard.

    A beam full of links has more behind it: such queries share what their neighbours' beams
    found, as far as their own similarity reaches. Each audited query must reach the recall for
    its own links, and one without links must have met its nearest neighbour, so a crowd cannot
    outweigh pairs and a shard without links is measured too. On a miss beams double, only the
    full ones where only those missed; where beams grow wider than WIDEST, exact products decide.
    """
    units, n = _unit(q), len(x)
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    nearest = np.full(len(q), -np.inf, np.float32)  # similarity of the best row met besides the own
    audited: list[int] = []
    todo, beam = np.arange(len(q)), BEAM
    while len(todo):
        full: list[int] = []
        for a in range(0, len(todo), 512):
            part = todo[a : a + 512]
            ids, sims = graph.search(units[part], beam)
            close = (ids >= 0) & (sims >= threshold - 1e-4)
            for i, (row, hit) in enumerate(zip(ids, close, strict=True)):
                found[part[i]] = row[hit]
            nearest[part] = np.where((ids < 0) | (ids == own_row[part, None]), -np.inf, sims).max(1)
            full += part[close[:, -1]].tolist()
        for own, rows in _crowds(found, full, own_row):
            for a in range(0, len(own), 512):
                near = units[own[a : a + 512]] @ graph.x[rows].T >= threshold - 1e-4
                for i, hit in zip(own[a : a + 512], near, strict=True):
                    found[i] = rows[hit]
        if not audited:
            audited = _auditors(np.array([np.count_nonzero(rows != me) for rows, me in zip(found, own_row, strict=True)])).tolist()
            exact = units[audited] @ graph.x.T
            mine = own_row[audited]
            exact[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        missed = set()
        for i, sims in zip(audited, exact, strict=True):
            linked = sims >= threshold
            if linked[np.unique(found[i])].sum() < RECALL * linked.sum() or not linked.any() and nearest[i] < sims.max() - 1e-5:
                missed.add(i)
        if not missed:
            break
        todo, beam = np.array(full) if missed <= set(full) else np.arange(len(q)), beam * 2
        if beam > WIDEST * n:
            for a in range(0, len(todo), 512):
                part = todo[a : a + 512]
                for i, hit in zip(part, units[part] @ graph.x.T >= threshold - 1e-4, strict=True):
                    found[i] = np.flatnonzero(hit)
            break
    for i, rows in enumerate(found):  # cosine in double precision decides
        if len(rows):
            v = q[i].astype(np.float64)
            cos = x[rows].astype(np.float64) @ v / (norm[rows] * np.linalg.norm(v))
            found[i] = rows[cos >= threshold]
    return found


def _ask(threshold: float):
    def ask(index: pa.Table, queries: pa.Table) -> pa.Table:
        """Block of queries and one shard -> links counted, and edges to local roots."""
        if not index.num_rows or not queries.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        q = matrix(queries)
        x = np.frombuffer(index["rows"][0].as_py(), np.float32).reshape(-1, q.shape[1])
        ids, copies = np.frombuffer(index["ids"][0].as_py(), np.int64).reshape(2, -1)
        graph = Graph.__new__(Graph)
        graph.x, (graph.entry, graph.layers) = _unit(x), pickle.loads(index["graph"][0].as_py())
        own = queries["vec_id"].to_numpy()
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)  # the index is sorted by id
        own_row = np.where(ids[at] == own, at, -1)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        count: dict[int, int] = {}
        for me, rows in zip(own.tolist(), _links(graph, x, q, own_row, threshold), strict=True):
            others = ids[rows] != me
            count[me] = int(copies[rows][others].sum())
            for other in ids[rows][others].tolist():
                a, b = root(me), root(other)
                parent[max(a, b)] = min(a, b)
        names = sorted(count.keys() | parent.keys())
        return pa.table({"vec_id": pa.array(names, pa.int64()), "root": pa.array([root(v) for v in names], pa.int64()), "n": pa.array([count.get(v, 0) for v in names], pa.int64())})

    return ask


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vec_id, embedding, label``.

    Equal vectors of a label are one point with a number of copies, whatever that number is.
    Vectors that are null, zero, hold null or non-finite components, have no label or no id link
    with nothing and are their own component. Lengths may differ between labels, not within one:
    rows of another length than the label's longest link with nothing. Rows that repeat an id
    with another vector count as further vectors of that id.
    """
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).where(norm > 0)
    longest = good.groupBy("label").agg(F.max(F.size("embedding")).alias("width"))
    good = good.join(longest, "label").where(F.size("embedding") == F.col("width")).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    points = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies")), "vec-points")
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.select("label", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = points.join(plan, "label").withColumns({
        "shard": F.pmod(F.xxhash64("vec_id"), "shards").cast("int"), "block": F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int"), "label": F.col("label").cast("int")
    })
    index = written(dealt.select("label", "shard", "vec_id", "copies", "embedding").groupBy("label", "shard").applyInArrow(_build, INDEX), "vec-index")
    asked = index.join(plan.withColumn("label", F.col("label").cast("int")), "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    asking = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("label", "shard", "block", "vec_id", "embedding")
    keys = ["label", "shard", "block"]
    found = written(asked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_ask(threshold), FOUND), "vec-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    point = points.join(counts, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        F.col("label"), F.col("embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    own = good.join(point, ["label", "embedding"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and cut into buckets of similar length; queries are taken in blocks.
For a query with k-th best score t so far, a bucket of length at most l can only help where the
cosine is at least t / (|q| l), the local threshold. Over 1, the query skips the bucket. A high
threshold prunes by coordinate: a vector whose cosine with q is at least c has, in the coordinate
where q is largest, a value between q_f c - sqrt((1 - q_f^2)(1 - c^2)) and q_f c + that root. A
low one prunes by length: only the vectors with |x| >= t / |q| remain. What is left is verified by
exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karvan.llm.common import written
from karvan.llm.embedding_dedup import usable

#: Vectors in a bucket, queries in a block, buckets that run through one task for a block.
BUCKET, BLOCK, LANE = 2_048, 256, 16
#: Local threshold from which a bucket is pruned by coordinate.
BY_COORDINATE = 0.5
NOTHING = np.iinfo(np.int64).min
LARGEST = np.iinfo(np.int64).max


def quantized(embedding, scale: int = 64):
    """floor(scale * x) of every component, as integers; beyond 2^62 the nearest of those."""
    most = F.lit(float(1 << 62))
    return F.transform(embedding, lambda x: F.floor(F.least(most, F.greatest(-most, F.lit(scale) * x.cast("double")))).cast("long"))


class TopK:
    """The best ``k`` (score, smaller id first) of every query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.most = int(np.abs(q).max(initial=0)) * q.shape[1]
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.focus = np.abs(q).argmax(1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), NOTHING, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """One bucket, its rows by falling length."""
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        unit = x / np.maximum(length, 1e-300)[:, None]
        fits = self.most * int(np.abs(x).max(initial=0)) <= LARGEST
        longest = float(length[0])
        for i in range(len(self.ids)):
            t, span = int(self.floor[i]), self.norm[i] * longest
            rows = None
            if t > 0:
                if t > span * (1 + 1e-9):
                    continue
                local = t / span * (1 - 1e-9)  # rounding errors only ever keep a vector
                if local >= BY_COORDINATE:
                    f = self.focus[i]
                    u = self.q[i, f] / self.norm[i]
                    reach = np.sqrt(max(0.0, (1 - u * u) * (1 - local * local))) + 1e-9
                    rows = np.flatnonzero((unit[:, f] >= u * local - reach) if u > 0 else (unit[:, f] <= u * local + reach))
                else:
                    rows = np.arange(np.searchsorted(-length, -t / self.norm[i] * (1 - 1e-9), side="right"))
                if not len(rows):
                    continue
            some = x if rows is None else x[rows]
            score = some @ self.q[i] if fits else self._wide_products(some, i)
            self._merge(i, ids if rows is None else ids[rows], score)

    def _wide_products(self, x: np.ndarray, i: int) -> np.ndarray:
        """Exact products; one outside of 64 bits is the nearest number of 64 bits."""
        wide = x.astype(object) @ self.q[i].astype(object)
        return np.array([max(-LARGEST, min(LARGEST, v)) for v in wide], np.int64)

    def _merge(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.floor[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        s, v = np.r_[self.best[i][0], score[keep]], np.r_[self.best[i][1], ids[keep]]
        order = np.lexsort((v, -s))[: self.k]
        self.best[i] = (s[order], v[order])
        if len(order) == self.k:
            self.floor[i] = s[order[-1]]

    def rows(self) -> pa.RecordBatch:
        size = [len(s) for s, _ in self.best]
        flat = [np.concatenate([b[j] for b in self.best]) if self.best else np.zeros(0, np.int64) for j in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, size)), pa.array(flat[1]), pa.array(flat[0])], ["query_id", "vec_id", "score"])


def _packed(vectors: DataFrame, key: str, longest_first: bool, dims: int) -> DataFrame:
    """Rows ``(key, ids, rows)``: the vectors of a block or bucket as one value of bounded size."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        given = table["v"].to_pylist()
        x = np.zeros((len(given), dims), np.int64)
        for row, v in zip(x, given, strict=True):
            row[: len(v)] = v
        order = np.lexsort((ids, -(x.astype(np.float64) ** 2).sum(1))) if longest_first else np.argsort(ids, kind="stable")
        narrow = np.abs(x).max(initial=0) <= np.iinfo(np.int32).max
        body = x[order].astype(np.int32 if narrow else np.int64).tobytes()
        return pa.table({key: table[key][:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "rows": pa.array([body], pa.binary()), "narrow": pa.array([bool(narrow)])})

    return vectors.select(key, "vec_id", "v").groupBy(key).applyInArrow(pack, f"{key} long, ids binary, rows binary, narrow boolean")


def top_products(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer products of every query row.

    ``vectors`` has ``vec_id`` and an integer array ``v``; ``is_query`` is a condition on its rows.
    Components that a shorter vector lacks count as 0. Products are exact; one outside of 64 bits
    counts as the nearest number of 64 bits. A query meets every row but those with its own id; ties go to the
    smaller id; fewer rows give fewer ranks. Repeated rows of an id count once when equal.
    """
    rows = written(vectors.where("vec_id is not null").select("vec_id", "v").distinct(), "top-vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = rows.withColumn("sq", square)
    parts = max(1, -(-n // BUCKET))
    spread = lengths.repartitionByRange(parts, F.desc("sq"), "vec_id").withColumn("bucket", F.spark_partition_id().cast("long"))
    cut = Window.partitionBy("bucket").orderBy(F.desc("sq"), "vec_id")
    fine = spread.withColumn("piece", F.floor((F.row_number().over(cut) - 1) / BUCKET)).withColumn("bucket", F.col("bucket") * 1_000_000 + F.col("piece"))
    buckets = written(_packed(fine, "bucket", True, dims), "top-buckets")
    asking = rows.where(is_query)
    blocks = max(1, -(-asking.count() // BLOCK))
    queries = written(_packed(asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")), "block", False, dims), "top-queries")
    # every block of queries meets every bucket: LANE buckets of falling length run through a task
    lanes = max(1, -(-buckets.count() // LANE))
    lane = F.pmod(F.xxhash64("bucket"), F.lit(lanes)).cast("int")
    left = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select("block", "lane", F.lit(-1).cast("long").alias("at"), "ids", "rows", "narrow")
    right = buckets.withColumn("lane", lane).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select("block", "lane", F.col("bucket").alias("at"), "ids", "rows", "narrow")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")  # the queries come first, then buckets of falling length
        parts = zip(table["ids"].to_pylist(), table["rows"].to_pylist(), table["narrow"].to_pylist(), strict=True)
        raw = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32 if narrow else np.int64)) for a, b, narrow in parts]
        if table["at"][0].as_py() != -1:
            return pa.Table.from_batches([TopK(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), k).rows()])
        ids, q = raw[0]
        top = TopK(ids, q.reshape(len(ids), -1).astype(np.int64), k)
        for ids, x in raw[1:]:
            top.add(ids, x.reshape(len(ids), -1).astype(np.int64))
        return pa.Table.from_batches([top.rows()])

    found = left.unionByName(right).groupBy("block", "lane").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable_integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` of the rows whose vector is whole: not null, no null or non-finite component.

    Any length and size of components will do.
    """
    return vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"))

"""MinHash near-deduplication by improved consistent weighted sampling.

A document is a weighted set: its shingles of five words, weighted by TF-IDF. Consistent weighted
samples of two sets agree with a probability equal to their weighted Jaccard similarity; samples
are banded, documents that share a band are candidates, and every link is verified by the exact
weighted Jaccard similarity of the two sets.

Identical texts are one document here and are joined again by class id at the end. Document
frequencies count every distinct text of the corpus. A text can only be 0.8 similar to another
if shingles of at least 0.8 of its weight occur in other texts; those without are settled.
Inside a band bucket documents are compared with its pivot (the most central one, whose shingles
most texts share). What no pivot explains is compared in blocks with what met the same pivot; a
block emits a spanning forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import WORD, mix64, written
from karvan.llm.groups import bucket_key, found_in, in_groups, pack, pack_sorted, plan_sizes, rolling, slices, starts_of, texts_of, unpack, unpack_sorted, word_hashes
from karvan.operators.graph import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares one of 10 bands of 3 samples with probability 0.9992.
BANDS, ROWS = 10, 3
#: Documents in a block where those left by a pivot are compared, bytes of such sets in a task's group.
BLOCK, SLOT_BYTES = 256, 4 << 20
#: Parts in which the copies of one text are handed the class of the text.
PARTS = 64
SIDE = "g int, bucket int, fp binary, df binary"
SIGNED = "doc_id long, bands array<long>, shingles binary, weights binary, outlying double"


def tf_idf(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """Sublinear term frequency times a saturated inverse document frequency.

    Shingles of at most 5 % of the texts weigh the same, so copies are not pulled apart by the
    rare words in which they differ; boilerplate weighs less, 0.7 at the least.
    """
    rarity = np.log(n / np.minimum(df, n)) / np.log(20) if n else np.ones(len(df))
    return (1 + np.log(tf)) * np.clip(rarity, 0.7, 1.0) if n >= 20 else 1 + np.log(tf)


def shingles_of(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter text is one run; an empty one has none."""
    words = text.split()
    return rolling(word_hashes(words), min(n, len(words))) if words else np.zeros(0, np.uint64)


def _gamma_table() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 65536 even steps, by bisection."""
    p, low, high = (np.arange(65536) + 0.5) / 65536, np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return ((low + high) / 2).astype(np.float32)


GAMMA = _gamma_table()
LOG_GAMMA = np.log(GAMMA)
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(items: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bands of several weighted sets stored one after the other: one row per set.

    Each sample draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) per item from one hash of the item and
    takes the item with the least ln c - r (t - b) - r, t = floor(ln w / r + b), together with t.
    """
    log_w = np.log(weights).astype(np.float32)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(items)]))
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k, seed in enumerate(SEEDS):
        u = mix64(items ^ seed)
        r = GAMMA[(u & np.uint64(0xFFFF)).astype(np.int64)]
        b = ((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + b)
        a = LOG_GAMMA[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - b) - r
        at = np.flatnonzero(a == np.minimum.reduceat(a, starts)[owner])
        at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]
        sample = mix64(items[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        out[:, k // ROWS] = mix64(out[:, k // ROWS] ^ sample ^ np.uint64(k % ROWS + 1))
    return out


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})


def _distinct(table: pa.Table, side: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(doc_id, shingles, counts) of the first text of each set of copies."""
    copies = {i for raw, b in zip(side["fp"].to_pylist(), side["bucket"].to_pylist(), strict=True) if b < 0 for i in unpack(raw, np.int64).tolist()}
    for doc_id, text in texts_of(table):
        if doc_id is not None and doc_id not in copies and len(s := shingles_of(text)):
            yield doc_id, *np.unique(s, return_counts=True)


def _count(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Group -> slices of its distinct shingles and in how many of its texts each occurs."""

    def send(table: pa.Table, side: pa.Table) -> pa.Table:
        keys = [bucket_key(s, buckets) for _, s, _ in _distinct(table, side)]
        if not keys:
            return _table(SIDE, [])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        g = table["g"][0].as_py()
        return _table(SIDE, [(g, b, pack_sorted(key[s].astype(np.uint32)), pack(n[s].astype(np.uint32))) for b, s in slices(key)])

    return send


def _total(table: pa.Table) -> pa.Table:
    """Bucket -> per group, its shingles of two or more texts with their document frequency."""
    fps = [unpack_sorted(x, np.uint32) for x in table["fp"].to_pylist()]
    fp, n = np.concatenate(fps), np.concatenate([unpack(x, np.uint32) for x in table["df"].to_pylist()])
    order = np.argsort(fp, kind="stable")
    at = starts_of(fp[order])
    df = np.empty(len(fp), np.uint32)
    df[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.r_[at, len(fp)]))
    out, ends, bucket = [], np.cumsum([0, *map(len, fps)]), table["bucket"][0].as_py()
    for i, g in enumerate(table["g"].to_pylist()):
        own = df[ends[i] : ends[i + 1]]
        if (own > 1).any():
            out.append((g, bucket, pack_sorted(fps[i][own > 1]), pack(own[own > 1])))
    return _table(SIDE, out)


def _sign(buckets: int, n: int, threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Group and its document frequencies -> bands and weighted shingles of texts that can have a match."""

    def sign(table: pa.Table, side: pa.Table) -> pa.Table:
        rows = [(b, f, d) for b, f, d in zip(side["bucket"].to_pylist(), side["fp"].to_pylist(), side["df"].to_pylist(), strict=True) if b >= 0]
        known, df = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        if rows:
            known = np.concatenate([unpack_sorted(f, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, f, _ in rows])
            df = np.concatenate([unpack(d, np.uint32) for *_, d in rows])
            order = np.argsort(known, kind="stable")
            known, df = known[order], df[order]
        ids, items, weights, outlying = [], [], [], []
        out: list[tuple] = []

        def flush() -> None:
            if ids:
                starts = np.cumsum([0, *map(len, items)])[:-1]
                bands = band_keys(np.concatenate(items), np.concatenate(weights), starts).view(np.int64)
                out.extend((i, b.tolist(), pack_sorted(s), pack(w), o) for i, b, s, w, o in zip(ids, bands, items, weights, outlying, strict=True))
            for kept in (ids, items, weights, outlying):
                kept.clear()

        for doc_id, s, tf in _distinct(table, side):
            hit, at = found_in(bucket_key(s, buckets), known)
            if not hit.any():
                continue
            w = tf_idf(tf, np.where(hit, df[at], 1), n).astype(np.float32)
            if w[hit].sum() >= threshold * w.sum() * (1 - 1e-6):
                ids.append(doc_id)
                items.append(s)
                weights.append(w)
                outlying.append(-float(np.log(np.where(hit, df[at], 1)).mean()))  # the source of many copies has the least
                if sum(map(len, items)) > 100_000:
                    flush()
        flush()
        return _table(SIGNED, out)

    return sign


def _copies(table: pa.Table) -> pa.Table:
    return _table(SIDE, [(table["g"][0].as_py(), -1, pack(table["doc_id"].to_numpy()), b"")])


def _shared(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> float:
    """Exact weighted Jaccard similarity of two sets."""
    hit, at = found_in(sb, sa)
    both = float(np.minimum(wb[hit], wa[at[hit]]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)`` with ``similarity`` of the two stored sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        for batch in batches:
            got = {n: batch.column(n).to_pylist() for n in ("a", "sa", "wa", "sb", "wb")}
            out = []
            for a, sa, wa, sb, wb in zip(got["a"], got["sa"], got["wa"], got["sb"], got["wb"], strict=True):
                if last[0] != a:
                    last = (a, unpack_sorted(sa, np.uint64), unpack(wa, np.float32))
                out.append(_shared(last[1], last[2], unpack_sorted(sb, np.uint64), unpack(wb, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(compare, "a long, b long, similarity double")


def _block_links(sets: list[tuple[np.ndarray, np.ndarray]], left: list[int], right: list[int], threshold: float) -> Iterator[tuple[int, int]]:
    """Linked pairs between two lists of sets; the sum of sqrt(w w') bounds the shared weight from above."""
    rows = sorted({*left, *right})
    item = np.concatenate([sets[r][0] for r in rows])
    root = np.sqrt(np.concatenate([sets[r][1] for r in rows]))
    owner = np.repeat(np.arange(len(rows)), [len(sets[r][0]) for r in rows])
    names, column, count = np.unique(item, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column, root = owner[keep], rank[column[keep]], root[keep]
    at = {r: i for i, r in enumerate(rows)}
    li, ri = np.array([at[r] for r in left]), np.array([at[r] for r in right])
    bound = np.zeros((len(left), len(right)), np.float32)
    width = max(1, 2_000_000 // len(rows))  # columns at a time
    order = np.argsort(column, kind="stable")
    owner, column, root = owner[order], column[order], root[order]
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        dense = np.zeros((len(rows), width), np.float32)
        dense[owner[a:b], column[a:b] - start] = root[a:b]
        bound += dense[li] @ dense[ri].T
    weight = np.array([sets[r][1].sum(dtype=np.float64) for r in rows])
    total = weight[li][:, None] + weight[ri][None, :]
    for i, j in zip(*np.nonzero(bound * (1 + 1e-5) >= threshold * (total - bound)), strict=True):
        x, y = left[i], right[j]
        if x != y and _shared(*sets[x], *sets[y]) >= threshold:
            yield x, y


def _compare_blocks(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Rows of several blocks of pivots' groups -> links, one spanning forest per block pair."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("p", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")])
        keys = list(zip(*(table[n].to_pylist() for n in ("p", "i", "j")), strict=True))
        ids, own = table["doc_id"].to_pylist(), table["own"].to_pylist()
        out: list[tuple] = []
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            _, i, j = keys[at]
            part = table.slice(at, end - at)
            sets = [(unpack_sorted(s, np.uint64), unpack(w, np.float32)) for s, w in zip(part["shingles"].to_pylist(), part["weights"].to_pylist(), strict=True)]
            left = [r for r in range(end - at) if own[at + r] == i]
            right = [r for r in range(end - at) if own[at + r] == j]
            parent = list(range(end - at))

            def root(v: int, parent: list[int] = parent) -> int:
                while parent[v] != v:
                    parent[v] = v = parent[parent[v]]
                return v

            for x, y in _block_links(sets, left, right, threshold) if left and right else ():
                if (u := root(x)) != (v := root(y)):
                    parent[max(u, v)] = min(u, v)
                    out.append((ids[at + x], ids[at + y]))
            at = end
        return _table("a long, b long", out)

    return compare


def link_buckets(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified links ``(a, b)`` that connect all linked documents of ``(bucket, doc_id, outlying)``.

    Every document is compared with the pivot of each of its buckets: the most central document,
    the least outlying, then the smallest id. Those a pivot links are settled by it. The others
    are compared with all that met the same pivot, in blocks of bounded size that emit no more
    than a spanning forest of their links.
    """
    place = F.struct("outlying", "doc_id")
    pivots = members.groupBy("bucket").agg(F.min(place).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "pivot")
    met = members.join(pivots, "bucket").where(place > F.col("pivot")).select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    judged = written(similarities(met, sets), "near-judged")
    settled = F.col("similarity") >= threshold
    groups = judged.groupBy("a").agg(F.count_if(~settled).alias("open"), F.count_if(settled).alias("done")).where("open > 0 and open + done > 1")
    groups = groups.select("a", F.ceil(F.col("open") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("done") / BLOCK).cast("int").alias("ny"))
    dealt = judged.join(groups, "a").withColumn("own", F.when(~settled, F.pmod(F.xxhash64("b"), "nx")).otherwise(F.col("nx") + F.pmod(F.xxhash64("b"), F.greatest("ny", F.lit(1)))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    open_to = F.transform(to(F.col("nx")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    open_to_done = F.when(F.col("ny") > 0, F.transform(to(F.col("ny")), lambda j: F.struct(F.col("own").alias("i"), (F.col("nx") + j).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    done_to = F.transform(to(F.col("nx")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    goes = dealt.select(F.col("a").alias("p"), F.col("b").alias("doc_id"), "own", F.explode(F.when(~settled, F.concat(open_to, open_to_done)).otherwise(done_to)).alias("to"))
    goes = goes.select("p", "doc_id", "own", "to.i", "to.j")
    size = sets.agg(F.avg(F.octet_length("shingles") + F.octet_length("weights"))).first()[0] or 0
    slots = max(96, int(judged.count() * size) // SLOT_BYTES)
    rows = goes.join(sets.select("doc_id", "shingles", "weights"), "doc_id").withColumn("slot", F.pmod(F.xxhash64("p", "i", "j"), F.lit(slots)))
    more = rows.groupBy("slot").applyInArrow(_compare_blocks(threshold), "a long, b long")
    return judged.where(settled).select("a", "b").unionByName(more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id)`` for every row of ``docs``: the smallest id of its class of near copies.

    Classes are the components of all verified links and of identical texts. A text of fewer
    than five words is one shingle; null and empty texts have none and stand alone; rows with a
    null id have a null class; rows that repeat an id count as one document.
    """
    digest = F.when(F.regexp_like("text", F.lit(WORD)), F.md5("text"))
    ids = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")), "near-ids")
    texts = ids.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    texts = written(texts.where("n > 1").select("digest", "first"), "near-texts")  # a side of its own, so a text with many copies can be split
    named = ids.join(texts, "digest", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    first = written(named.groupBy("doc_id").agg(F.min("first").alias("first")), "near-first")

    groups, buckets = plan_sizes(docs)
    body = in_groups(docs, groups).groupBy("g")
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    copies = first.where("first <> doc_id").select(group.alias("g"), "doc_id").groupBy("g").applyInArrow(_copies, SIDE)
    counted = body.cogroup(copies.groupBy("g")).applyInArrow(_count(buckets), SIDE).groupBy("bucket").applyInArrow(_total, SIDE)
    n = first.where("first = doc_id").count()
    sets = written(body.cogroup(copies.unionByName(counted).groupBy("g")).applyInArrow(_sign(buckets, n, threshold), SIGNED), "near-sets")

    bands = sets.select("doc_id", "outlying", F.posexplode("bands").alias("band", "key"))
    members = written(bands.select(F.xxhash64("band", "key").alias("bucket"), "doc_id", "outlying"), "near-members")
    links = written(link_buckets(members, sets, threshold), "near-links")
    if not links.isEmpty():
        classes = connected_components(links)
        # A text may have any number of copies: each of its parts meets the class of the text once.
        parted = first.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
        texts = parted.select("first", "part").distinct().join(classes, F.col("first") == F.col("node"))
        texts = texts.select(F.col("first").alias("_text"), F.col("part").alias("_part"), "component")
        same = (F.col("first") == F.col("_text")) & (F.col("part") == F.col("_part"))
        first = parted.join(texts, same, "left").select("doc_id", F.coalesce("component", "first").alias("class_id"))
    else:
        first = first.withColumnRenamed("first", "class_id")
    return ids.select("doc_id").join(first, "doc_id", "left")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that head their class; same columns. Rows with a null id all stay."""
    gone = near_duplicates(docs, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")

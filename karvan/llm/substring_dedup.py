"""Substring deduplication by fixed-block anchors.

A window is a run of 50 words. The index holds the non-overlapping blocks of 25 words of every
document; any window covers one whole block of its reference. Every rolling run of 25 words of
every document probes the index; around the hits the match is extended through all windows that
reach over the hit, and windows that go on matching chain into maximal exact repeats. Extension
compares window fingerprints (64 bits inside a bucket that a second, independent hash names)
against the smallest document that holds the window, so a passage shared by any number of
documents costs one entry per group of documents, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.groups import FACTORS, bucket_key, found_in, in_groups, pack, pack_sorted, plan_sizes, rolling, slices, starts_of, texts_of, unpack, unpack_sorted, word_hashes

WINDOW = 50
SLICE = "bucket int, g int, fp binary, flag binary"
HITS = "g int, bucket int, fp binary, owner binary"


def _hashed(table: pa.Table, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, word hashes) of the documents long enough to hold a window."""
    for doc_id, text in texts_of(table):
        words = text.split()
        if doc_id is not None and len(words) >= window:
            yield doc_id, word_hashes(words)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})


def _anchors(block: int, window: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Group -> slices of distinct rolling runs; flag 1 = some run is an indexed block, 2 = several documents."""

    def send(table: pa.Table) -> pa.Table:
        keys, owners, aligned = [], [], []
        for doc_id, h in _hashed(table, window):
            k = bucket_key(rolling(h, block), buckets)
            keys.append(k)
            owners.append(np.full(len(k), doc_id, np.int64))
            aligned.append(np.arange(len(k)) % block == 0)
        if not keys:
            return _rows(SLICE, [])
        g, key = table["g"][0].as_py(), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], np.concatenate(owners)[order]
        at = starts_of(key)
        several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        flag = np.maximum.reduceat(np.concatenate(aligned)[order].astype(np.uint8), at) | several.astype(np.uint8) << 1
        key = key[at]
        return _rows(SLICE, [(b, g, pack_sorted(key[s].astype(np.uint32)), flag[s].tobytes()) for b, s in slices(key)])

    return send


def _meet(table: pa.Table) -> pa.Table:
    """Bucket -> per group, the runs that other documents share and some document has as a block."""
    groups = table["g"].to_pylist()
    fps = [unpack_sorted(x, np.uint32) for x in table["fp"].to_pylist()]
    fp, flag = np.concatenate(fps), np.concatenate([np.frombuffer(x, np.uint8) for x in table["flag"].to_pylist()])
    order = np.argsort(fp, kind="stable")
    at = starts_of(fp[order])
    size = np.diff(np.r_[at, len(fp)])
    any_flag = np.bitwise_or.reduceat(flag[order], at)
    hit = ((any_flag & 1) > 0) & ((size > 1) | ((any_flag & 2) > 0))
    chosen = np.zeros(len(fp), bool)
    chosen[order] = np.repeat(hit, size)
    bucket, out, ends = table["bucket"][0].as_py(), [], np.cumsum([0, *map(len, fps)])
    for i, g in enumerate(groups):
        part = fps[i][chosen[ends[i] : ends[i + 1]]]
        if len(part):
            out.append((g, bucket, pack_sorted(part), b""))
    return _rows(HITS, out)


def _windows(block: int, window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Group and its hits -> the windows that reach over a hit, with their smallest document."""

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not hits.num_rows or not table.num_rows:
            return _rows("bucket int, g int, fp binary, flag binary, owner binary", [])
        known = np.sort(np.concatenate([unpack_sorted(f, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, f in zip(hits["bucket"].to_pylist(), hits["fp"].to_pylist(), strict=True)]))
        where, what, owners = [], [], []
        for doc_id, h in _hashed(table, window):
            hit, _ = found_in(bucket_key(rolling(h, block), buckets), known)
            reach = np.cumsum(np.r_[0, hit])
            start = np.arange(len(h) - window + 1)
            near = start[reach[start + window - block + 1] > reach[start]]  # a hit starts in [start, start + window - block]
            if len(near):
                where.append((rolling(h, window, FACTORS[1])[near] % np.uint64(buckets)).astype(np.int64))
                what.append(rolling(h, window)[near])
                owners.append(np.full(len(near), doc_id, np.int64))
        if not what:
            return _rows("bucket int, g int, fp binary, flag binary, owner binary", [])
        b, fp, owner = np.concatenate(where), np.concatenate(what), np.concatenate(owners)
        order = np.lexsort((fp, b))
        b, fp, owner = b[order], fp[order], owner[order]
        at = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (b[1:] != b[:-1])])
        least = np.minimum.reduceat(owner, at)
        several = (least != np.maximum.reduceat(owner, at)).astype(np.uint8)
        b, fp = b[at], fp[at]
        g, ends = table["g"][0].as_py(), starts_of(b)
        return _rows(
            "bucket int, g int, fp binary, flag binary, owner binary",
            [(int(b[x]), g, pack_sorted(fp[x:y]), several[x:y].tobytes(), pack(least[x:y])) for x, y in zip(ends, np.r_[ends[1:], len(b)], strict=True)],
        )

    return extend


def _owners(table: pa.Table) -> pa.Table:
    """Bucket -> per group, its windows that several documents hold and their smallest document."""
    groups = table["g"].to_pylist()
    fps = [unpack_sorted(x, np.uint64) for x in table["fp"].to_pylist()]
    fp, flag = np.concatenate(fps), np.concatenate([np.frombuffer(x, np.uint8) for x in table["flag"].to_pylist()])
    owner = np.concatenate([unpack(x, np.int64) for x in table["owner"].to_pylist()])
    order = np.argsort(fp, kind="stable")
    at = starts_of(fp[order])
    size = np.diff(np.r_[at, len(fp)])
    first, shared = np.empty(len(fp), np.int64), np.empty(len(fp), bool)
    first[order] = np.repeat(np.minimum.reduceat(owner[order], at), size)
    shared[order] = np.repeat((size > 1) | (np.maximum.reduceat(flag[order], at) > 0), size)
    bucket, out, ends = table["bucket"][0].as_py(), [], np.cumsum([0, *map(len, fps)])
    for i, g in enumerate(groups):
        s = slice(ends[i], ends[i + 1])
        keep = shared[s]
        if keep.any():
            out.append((g, bucket, pack_sorted(fps[i][keep]), pack(first[s][keep])))
    return _rows(HITS, out)


def _cut(window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Group and the owners of its shared windows -> one row per document."""

    def finish(table: pa.Table, hits: pa.Table) -> pa.Table:
        known, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if hits.num_rows:
            known = np.concatenate([unpack_sorted(f, np.uint64) for f in hits["fp"].to_pylist()])
            owner = np.concatenate([unpack(o, np.int64) for o in hits["owner"].to_pylist()])
            order = np.argsort(known, kind="stable")
            known, owner = known[order], owner[order]
        out: dict[str, list] = {"doc_id": [], "text_sha": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        for doc_id, text in texts_of(table):
            words, spans, removed = text.split(), [], 0
            if doc_id is not None and len(words) >= window and len(known):
                hit, at = found_in(rolling(word_hashes(words), window), known)
                hit &= owner[at] < doc_id
                if hit.any():
                    edge = np.zeros(len(words) + 1, np.int64)
                    begin = np.flatnonzero(hit)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans, removed = turn.tolist(), int(gone.sum())
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
            for name, value in zip(out, (doc_id, hashlib.sha256(text).digest(), len(words) + removed, removed, hashlib.sha256(b" ".join(words)).hexdigest(), spans), strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    return finish


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, text_sha, n_words, n_removed, kept_sha256, spans``.

    Words covered by a window that also starts in a document with a smaller id are removed;
    ``spans`` lists where maximal repeats begin and end, in words, flat. Windows are judged on
    the input. Null texts have no words. Rows with a null id neither lose words nor make others
    lose any; rows that repeat an id count as one document and each get a row.
    """
    block = window // 2  # any window then covers an aligned block
    groups, buckets = plan_sizes(docs)
    texts = in_groups(docs, groups)
    by_group = texts.groupBy("g")
    anchors = by_group.applyInArrow(_anchors(block, window, buckets), SLICE)
    met = anchors.groupBy("bucket").applyInArrow(_meet, HITS)
    windows = by_group.cogroup(met.groupBy("g")).applyInArrow(_windows(block, window, buckets), "bucket int, g int, fp binary, flag binary, owner binary")
    owners = windows.groupBy("bucket").applyInArrow(_owners, HITS)
    return by_group.cogroup(owners.groupBy("g")).applyInArrow(
        _cut(window, buckets), "doc_id long, text_sha binary, n_words long, n_removed long, kept_sha256 string, spans array<int>"
    )


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``, ``n_chars`` adjusted.

    A text that loses words has its kept words joined by one space; all others stay as they are.
    """
    lost = repeated_spans(docs, window).where("n_removed > 0").select(F.col("doc_id").alias("_cut_id"), F.col("text_sha").alias("_cut_sha"), "spans")
    lost = lost.dropDuplicates(["_cut_id", "_cut_sha"]).withColumnRenamed("spans", "_cut_spans")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, edges in zip(texts, spans, strict=True):
                words = text.encode().split()
                at = [0, *edges, len(words)]
                out.append(b" ".join(w for i in range(0, len(at), 2) for w in words[at[i] : at[i + 1]]).decode())
            yield pd.Series(out, dtype="object")

    same = (F.col("doc_id") == F.col("_cut_id")) & (F.unhex(F.sha2("text", 256)) == F.col("_cut_sha"))
    joined = docs.join(lost, same, "left")
    hit = F.col("_cut_spans").isNotNull()
    changed = joined.where(hit).withColumn("text", cut("text", "_cut_spans"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where(~hit).select(*docs.columns).unionByName(changed.select(*docs.columns))

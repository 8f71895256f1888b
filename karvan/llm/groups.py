"""Documents in groups, and fingerprints exchanged between groups and buckets.

Comparing every run of words of a corpus with every other needs one exchange of fingerprints,
not of rows. Documents are dealt by id into groups of a bounded number of bytes. A group sends
each distinct fingerprint of its documents once, packed by bucket (a slice of the fingerprint
space); a bucket sees which fingerprints several groups sent and answers each group. A passage
in a third of all documents is therefore one entry per group, not one per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import mix64

#: Bytes of text in a group and words in a bucket; both fit a task's memory many times over.
GROUP_BYTES, BUCKET_WORDS = 8 << 20, 3_000_000
MIN_GROUPS, MIN_BUCKETS = 96, 48
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _WordHashes(dict):
    """Word -> 64-bit hash; emptied when full, which bounds a worker's memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, factor: np.uint64 = FACTORS[0]) -> np.ndarray:
    """Hash of every run of ``n`` values: a polynomial in ``factor`` by repeated doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    count, done, have, size, power, out = len(h) - n + 1, 0, h, 1, np.array([factor]), None
    while True:
        if n & size:
            part = have[done : done + count]
            out = part.copy() if out is None else out * power + part
            done += size
        if size * 2 > n:
            return mix64(out)
        have, size = have[:-size] * power + have[size:], size * 2
        power = power * power


def pack(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of close values become long runs, which shuffles compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def plan_sizes(docs: DataFrame) -> tuple[int, int]:
    """Numbers of groups and buckets for the bytes of text at hand."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(MIN_GROUPS, math.ceil(total / GROUP_BYTES)), max(MIN_BUCKETS, math.ceil(total / 6 / BUCKET_WORDS))


def in_groups(docs: DataFrame, groups: int) -> DataFrame:
    """``(g, doc_id, body)``: group, id and compressed text; a null text is empty."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("doc_id"), pa.array(body, pa.binary())], ["g", "doc_id", "body"])

    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    return docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compress, "g int, doc_id long, body binary")


def texts_of(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, text as UTF-8) of the rows of a group."""
    opener = zstandard.ZstdDecompressor()
    for doc_id, body in zip(table["doc_id"].to_pylist(), table["body"].to_pylist(), strict=True):
        yield doc_id, opener.decompress(body)


def bucket_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits of fingerprint in the low half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted bucket keys."""
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    at = starts_of(buckets)
    for a, b in zip(at, np.r_[at[1:], len(keys)], strict=True):
        yield int(buckets[a]), slice(int(a), int(b))


def found_in(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the values that are in a sorted array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at

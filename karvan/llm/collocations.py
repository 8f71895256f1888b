"""Phrases whose words keep together, from counts of all phrases of two to five words.

Word positions start suffixes of at most ``depth`` words that end with their piece. Suffixes are
routed to buckets by their leading words, so that a bucket holds all that start alike; there a
multikey three-way quicksort of suffix pointers divides them word by word. The size of an equal
partition is the count of the phrase that its suffixes share, and a partition too small for a
frequent phrase is abandoned, since nobody else has more of it.

This is done twice: for pairs, routed by one word, and for longer phrases, routed by two. Words
and pairs that cannot be frequent end a suffix before it is sent; a bitmap of fixed size tells
which, and may only keep too many. Equal suffixes of one chunk of text travel once, with their
number. Leading words of more than ``bucket_words`` suffixes are routed by one more word, up to
whole suffixes; counts of such leading words are then sums over buckets. A bitmap of fixed size
tells these too, where a clash only means one word more. So nothing that is sent to all tasks
grows with the corpus, and a bucket stays bounded under any repetition.

Cases: null texts are empty, null languages are ``und``, and words and pieces are split at ASCII
characters only, whatever the script. Empty tables and languages without a frequent phrase give
no rows. Repeated rows count each. Columns other than the two named ones do not matter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import mix64, written
from karvan.llm.groups import FACTORS, starts_of
from karvan.llm.merkle import in_positions

#: Longest phrase, least count of a candidate, ranks of a language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: A chunk of text is combined before it is sent, so many positions at a time.
CHUNK_BYTES, CHUNK_WORDS = 8 << 20, 1 << 19
#: Suffixes of a bucket before equal ones are combined; leading words with more are divided.
BUCKET_WORDS = 4_000_000
#: Bits of a bitmap (512 KB each).
SLOTS = 1 << 22
#: Ends of pieces and spaces, in UTF-8 bytes; 0xFF does not occur in UTF-8.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_STOP = b"\xff"
_END_HASH = np.uint64(0x5851F42D4C957F2D)


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with a stop after every piece."""
    return (text.translate(_FOLD) + b"\n").replace(b"\n", b" \xff ").split()


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, word ids, words by id) of chunks of text; id 0 is the end of a piece."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            body = (text or "").encode()
            held[lang].append(body)
            size[lang] += len(body)
            if size[lang] >= chunk_bytes or sum(size.values()) >= 2 * chunk_bytes:
                largest = max(size, key=size.__getitem__)
                size.pop(largest)
                yield from _numbered(largest, held.pop(largest))
    for lang, bodies in held.items():
        yield from _numbered(lang, bodies)


def _numbered(lang: str, bodies: list[bytes]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    ids: dict[bytes, int] = defaultdict(count().__next__)
    ids[_STOP]
    parts = [np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws)) for ws in map(words_of, bodies)]
    yield lang, np.concatenate(parts), list(ids)


def count_words(texts: DataFrame) -> DataFrame:
    """``(lang, word, n, pairs)``: occurrences of every word, and its different pairs per chunk."""

    def count_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in chunks(batches):
            n = np.bincount(ids, minlength=len(words))[1:]
            pairs = np.bincount(np.unique(ids[:-1] * len(words) + ids[1:]) // len(words), minlength=len(words))[1:]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "word": pa.array(words[1:], pa.binary()), "n": n, "pairs": pairs})

    counted = texts.mapInArrow(count_chunk, "lang string, word binary, n long, pairs long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))


def hashes_of(lang: str, words: Sequence[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    h[0] = _END_HASH
    return h


def bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """Bits of the slots in a column; at most ``size`` of them come to the driver."""
    bits = np.zeros(size, bool)
    bits[slots.select("slot").distinct().toArrow()["slot"].to_numpy()] = True
    return np.packbits(bits)


def _marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(3)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


class Suffixes:
    """The distinct suffixes of a part of a chunk: word ids by depth, numbers, routing hashes.

    ``joined`` tells of each position but the last ones whether its word goes on with the next.
    """

    def __init__(self, ids: np.ndarray, joined: np.ndarray, shortest: int, depth: int) -> None:
        at = np.flatnonzero(ids[: len(ids) - depth + 1])
        for d in range(shortest - 1):
            at = at[joined[at + d]]
        todo, alive = [ids[at]], np.ones(len(at), bool)
        for d in range(1, depth):
            alive &= joined[at + d - 1]
            todo.append(np.where(alive, ids[at + d], 0))
        # As many words as fit are packed into one number; ranks stand for the words so far.
        width = max(1, int(ids.max()).bit_length())
        mask, rank, rank_bits, known = (1 << width) - 1, np.zeros(len(at), np.int64), 0, []
        while todo:
            take = min(len(todo), (63 - rank_bits) // width)
            packed = rank
            for column in todo[:take]:
                packed = packed << width | column
            key, rank, self.weight = np.unique(packed, return_inverse=True, return_counts=True)
            known = [k[key >> (width * take)] for k in known] + [key >> (width * (take - 1 - i)) & mask for i in range(take)]
            todo, rank_bits = todo[take:], len(key).bit_length()
        self.columns = known

    def prefix_hash(self, hashes: np.ndarray, depth: int) -> np.ndarray:
        h = hashes[self.columns[0]]
        for column in self.columns[1:depth]:
            h = mix64(h * FACTORS[0] + hashes[column])
        return h


class Round:
    """What one round of counting counts, and the bitmaps that bound it.

    ``frequent`` and ``pairs`` mark words and pairs that may be frequent (no ``pairs``: all may);
    ``hot`` marks, per number of leading words, those that are routed by one more.
    """

    def __init__(self, shortest: int, depth: int, routed: int, least: int, frequent: np.ndarray, pairs: np.ndarray | None) -> None:
        self.shortest, self.depth, self.routed, self.least = shortest, depth, routed, least
        self.frequent, self.pairs, self.hot = frequent, pairs, {}

    def suffixes(self, lang: str, ids: np.ndarray, words: list[bytes]) -> Iterator[tuple[Suffixes, np.ndarray]]:
        """Suffixes of a chunk in parts, and hashes of its words."""
        hashes = hashes_of(lang, words)
        keep = _marked(self.frequent, hashes % np.uint64(len(self.frequent) * 8))
        keep[0] = False
        ids = np.r_[np.where(keep[ids], ids, 0), np.zeros(self.depth - 1, np.int64)]
        for start in range(0, len(ids) - self.depth + 1, CHUNK_WORDS):
            part = ids[start : start + CHUNK_WORDS + self.depth - 1]
            joined = (part[:-1] != 0) & (part[1:] != 0)
            if self.pairs is not None:
                pair = mix64(hashes[part[:-1]] * FACTORS[0] + hashes[part[1:]])
                joined &= _marked(self.pairs, pair % np.uint64(len(self.pairs) * 8))
            found = Suffixes(part, joined, self.shortest, self.depth)
            if len(found.weight):
                yield found, hashes

    def routes(self, suffixes: Suffixes, hashes: np.ndarray) -> np.ndarray:
        """How many leading words route each suffix: one more while the words so far are hot."""
        depth = np.full(len(suffixes.weight), self.routed, np.int8)
        for d, bits in sorted(self.hot.items()):
            depth[(depth == d) & _marked(bits, suffixes.prefix_hash(hashes, d) % np.uint64(len(bits) * 8))] = d + 1
        return depth


def find_hot(texts: DataFrame, counting: Round, first: DataFrame, bucket_words: int, slots: int) -> None:
    """Fill ``counting.hot``: leading words with more than ``bucket_words`` suffixes.

    ``first`` holds the slots of such words at the first routing depth. Deeper ones are counted
    in a pass of their own, only under hot ones, so most corpora take none.
    """
    d, bits = counting.routed, bitmap(first, slots)
    while bits.any() and d < counting.depth:
        counting.hot[d] = bits
        d += 1
        if d == counting.depth:
            break

        def count_leaders(batches: Iterator[pa.RecordBatch], d: int = d) -> Iterator[pa.RecordBatch]:
            for lang, ids, words in chunks(batches):
                for s, hashes in counting.suffixes(lang, ids, words):
                    at = counting.routes(s, hashes) == d
                    slot, n = np.unique(s.prefix_hash(hashes, d)[at] % np.uint64(slots), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"slot": slot.astype(np.int64), "n": n})

        counted = texts.mapInArrow(count_leaders, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        bits = bitmap(counted.where(F.col("n") > bucket_words), slots)


def divide(columns: Sequence[np.ndarray], weight: np.ndarray, least: int, whole_from: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of suffix pointers: (words, a pointer, count) of phrases.

    A partition holds pointers to suffixes with equal words before ``at``. Partitions of fewer
    than ``least`` suffixes are abandoned from ``whole_from`` words on; shorter phrases may have
    more suffixes in other buckets, so they are reported whatever their count.
    """
    open_ = [(np.arange(len(weight)), 0)]
    while open_:
        pointers, at = open_.pop()
        if not len(pointers) or (at + 1 >= whole_from and weight[pointers].sum() < least):
            continue
        key = columns[at][pointers]
        first, middle, last = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(first, middle), min(max(first, middle), last))
        equal = pointers[key == pivot]
        if len(equal) < len(pointers):
            open_.append((pointers[key < pivot], at))
            open_.append((pointers[key > pivot], at))
        if pivot == 0:
            continue
        size = int(weight[equal].sum())
        if size < least and at + 1 >= whole_from:
            continue
        yield at + 1, int(equal[0]), size
        if at + 1 < len(columns):
            open_.append((equal, at + 1))


def count_phrases(texts: DataFrame, counting: Round, buckets: int) -> DataFrame:
    """``(lang, words, a)``: phrases of ``shortest`` to ``depth`` words that occur often enough."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in chunks(batches):
            for s, hashes in counting.suffixes(lang, ids, words):
                routed = counting.routes(s, hashes)
                bucket = np.zeros(len(routed), np.int64)
                for d in range(counting.routed, counting.depth + 1):
                    at = routed == d
                    bucket[at] = (mix64(s.prefix_hash(hashes, d)[at]) % np.uint64(buckets)).astype(np.int64)
                key = bucket * (counting.depth + 1) + routed
                order = np.argsort(key, kind="stable")
                starts = starts_of(key[order])
                rows = [_parcel(lang, *divmod(int(key[order[a]]), counting.depth + 1), order[a:b], s, words) for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, PARCEL)

    def receive(parcels: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "words": [], "a": []}
        rows = parcels.to_pylist()
        for routed, lang in sorted({(r["routed"], r["lang"]) for r in rows}):
            columns, weight, words = _opened([r for r in rows if r["routed"] == routed and r["lang"] == lang], counting.depth)
            for n, pointer, size in divide(columns, weight, counting.least, routed):
                if n >= counting.shortest:
                    out["lang"].append(lang)
                    out["words"].append([words[c[pointer]].decode() for c in columns[:n]])
                    out["a"].append(size)
        return pa.table(out, pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64())]))

    parts = texts.mapInArrow(send, "bucket long, routed int, lang string, body binary, word_bytes int, wide boolean, ones boolean")
    found = parts.groupBy("bucket").applyInArrow(lambda t: receive(t), "lang string, words array<string>, a long")
    return found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= counting.least)


PARCEL = pa.schema([("bucket", pa.int64()), ("routed", pa.int32()), ("lang", pa.string()), ("body", pa.binary()), ("word_bytes", pa.int32()), ("wide", pa.bool_()), ("ones", pa.bool_())])


def _parcel(lang: str, bucket: int, routed: int, rows: np.ndarray, s: Suffixes, words: list[bytes]) -> dict:
    """Suffixes for one bucket, compressed, with a vocabulary of their own."""
    used, back = np.unique(np.concatenate([np.zeros(1, np.int64)] + [c[rows] for c in s.columns]), return_inverse=True)
    wide = len(used) > 0xFFFF
    ids = back[1:].astype(np.uint32 if wide else np.uint16)
    weight = s.weight[rows]
    ones = bool((weight == 1).all())
    text = b" ".join([words[i] for i in used[1:]])
    body = text + ids.tobytes() + (b"" if ones else weight.astype(np.int32).tobytes())
    return {"bucket": bucket, "routed": routed, "lang": lang, "body": zstandard.compress(body, 1), "word_bytes": len(text), "wide": wide, "ones": ones}


def _opened(parcels: list[dict], depth: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """All suffixes of a bucket over one vocabulary; id 0 stays the end."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    ids[_STOP]
    columns, weights = [], []
    for p in parcels:
        body = zstandard.decompress(p["body"])
        own = np.array([0] + [ids[w] for w in body[: p["word_bytes"]].split(b" ")], np.int32)
        kind = np.dtype(np.uint32 if p["wide"] else np.uint16)
        size = (len(body) - p["word_bytes"]) // (kind.itemsize * depth + 4 * (not p["ones"]))
        rows = np.frombuffer(body, kind, size * depth, p["word_bytes"]).reshape(depth, -1)
        columns.append(own[rows])
        weights.append(np.ones(size, np.int32) if p["ones"] else np.frombuffer(body[-4 * size :], np.int32))
    merged = np.concatenate(columns, axis=1)
    return list(merged), np.concatenate(weights).astype(np.int64), list(ids)


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def scored(phrases: DataFrame, sizes: DataFrame, least: int = LEAST) -> DataFrame:
    """Candidates with the lowest-scoring cut: ``lang, words, a, l, r, n, score``.

    ``phrases`` (lang, words, a) must hold all parts of its phrases. Scores are exact: products
    are decimals of 38 digits (1000 * a * n stays below them for n < 10^17).
    """
    long = phrases.where((F.size("words") > 1) & (F.col("a") >= least))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    left = phrases.select(F.col("lang").alias("_ll"), F.col("words").alias("_lw"), F.col("a").alias("l"))
    right = phrases.select(F.col("lang").alias("_rl"), F.col("words").alias("_rw"), F.col("a").alias("r"))
    both = cuts.join(left, (F.col("lang") == F.col("_ll")) & (F.col("head") == F.col("_lw"))).join(
        right, (F.col("lang") == F.col("_rl")) & (F.col("tail") == F.col("_rw"))
    )
    counted = both.join(sizes, "lang").withColumn("_above", _exact(F.col("a") * 1000) * _exact(F.col("n"))).withColumn("_below", _exact(F.col("l")) * _exact(F.col("r")))
    score = F.expr("_above div _below")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return counted.groupBy("lang", "words", "a", "n").agg(lowest.alias("_cut")).select("lang", "words", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def without_parts(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Leave out candidates inside a longer one that occurs ``percent`` % as often, dropped or not."""
    inner = candidates.where(F.size("words") > 2).select(
        F.col("lang").alias("_lang"),
        F.col("a").alias("_longer"),
        F.explode(
            F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))")
        ).alias("_part"),
    )
    most = inner.groupBy("_lang", "_part").agg(F.max("_longer").alias("_longer"))
    inside = (F.col("lang") == F.col("_lang")) & (F.col("words") == F.col("_part")) & (F.col("_longer") * 100 >= F.col("a") * percent)
    return candidates.join(most, inside, "left_anti")


def all_phrases(texts: DataFrame, words: DataFrame, depth: int, least: int, bucket_words: int, slots: int) -> DataFrame:
    """``(lang, words, a)`` of every phrase of 1 to ``depth`` words with ``least`` occurrences."""
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.where(F.col("n") >= least)
    frequent = bitmap(_slots(often, slots), slots)
    single = often.select("lang", F.array(F.col("word").cast("string")).alias("words"), F.col("n").alias("a"))
    if depth < 2:
        return single
    first = Round(2, 2, 1, least, frequent, None)
    find_hot(texts, first, _slots(words.where(F.col("pairs") > bucket_words), slots), bucket_words, slots)
    pairs = written(count_phrases(texts, first, math.ceil(total / bucket_words) or 1), "phrase-pairs")
    if depth < 3:
        return single.unionByName(pairs)
    inside = pairs.agg(F.sum("a")).first()[0] or 0
    rest = Round(3, depth, 2, least, frequent, bitmap(_slots(pairs, slots), slots))
    find_hot(texts, rest, _slots(pairs.where(F.col("a") > bucket_words), slots), bucket_words, slots)
    longer = count_phrases(texts, rest, math.ceil(inside / bucket_words) or 1)
    return single.unionByName(pairs).unionByName(longer)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, bucket_words: int = BUCKET_WORDS, slots: int = SLOTS) -> DataFrame:
    """The first ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(count_words(texts), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = written(all_phrases(texts, words, depth, least, bucket_words, slots), "phrases")
    kept = without_parts(written(scored(phrases, sizes, least), "phrase-scores"))
    keyed = kept.select(F.col("lang").alias("tree"), (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"), F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score")
    placed = in_positions(keyed, ["_s", "_a", "phrase"], "phrase-ranks").where(F.col("pos") < top)
    return placed.select(F.col("tree").alias("lang"), (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _slots(phrases: DataFrame, slots: int) -> DataFrame:
    """Slots of words (column ``word``) or of phrases (column ``words``) in a bitmap."""

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, words in zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist(), strict=True):
                hashes = hashes_of(lang, [_STOP, *[w.encode() for w in words]])[1:]
                h = hashes[:1]
                for other in hashes[1:]:
                    h = mix64(h * FACTORS[0] + other)
                found.append(int(h[0]) % slots)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(found, pa.int64())})

    words = F.col("words") if "words" in phrases.columns else F.array(F.col("word").cast("string"))
    return phrases.select("lang", words.alias("words")).mapInArrow(slot, "slot long")

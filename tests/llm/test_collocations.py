"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from karvan.llm import collocations as module
from karvan.llm.collocations import collocations, divide, words_of

LANGS = (None, "en", "de", "und")


def _brute(rows, least, top, depth=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join([c.lower() if "A" <= c <= "Z" else c for c in text or ""])
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, depth + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i : i + m]] = max(a, inside[lang, ws[i : i + m]])
    out = {}
    for (lang, ws), a in cand.items():
        if 100 * inside[lang, ws] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def _texts(seed, docs=60):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "zürich", "Éa", "x\x00y", "x y", "日本語", "q", "w'v"]
    phrases = ["New York city hall now", "of the", "a a a a a a", "red Herring", "one two three"]
    rows = []
    for _ in range(docs):
        ws = []
        for _ in range(rng.randint(0, 80)):
            ws.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocab))
            ws.append(rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n")))
        rows.append(("".join(ws), rng.choice(LANGS)))
    return [*rows, (None, "en"), ("", None), ("only", "fr"), *[rows[0]] * 5]


@pytest.mark.parametrize(("bucket_words", "slots", "least"), [(2_000_000, 1 << 12, 20), (40, 1 << 12, 20), (12, 64, 15), (5, 8, 30)])
def test_equal_to_plain_counts(spark, bucket_words, slots, least):
    rows = _texts(least + bucket_words)
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, n long").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs, least=least, top=25, bucket_words=bucket_words, slots=slots).collect())
    want = _brute(rows, least, 25)
    assert got == want and len(want) > 20


def test_no_rows(spark):
    docs = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0


def test_partitions_are_counts():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 4, (500, 3))
    rows[rows[:, 0] == 0, 1:] = 0
    rows[rows[:, 1] == 0, 2] = 0
    weight = rng.integers(1, 5, 500)
    got = Counter()
    for n, at, size in divide(list(rows.T), weight, 12, 1):
        got[tuple(rows[at, :n])] += size
    want = Counter()
    for row, w in zip(rows, weight, strict=True):
        for n in range(1, 4):
            if row[n - 1] != 0:
                want[tuple(row[:n])] += w
    assert dict(got) == {p: int(w) for p, w in want.items() if w >= 12}


def test_long_text_is_cut_into_parts(spark):
    text = " ".join(random.Random(1).choices("ab", k=3000))
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = sorted(tuple(r) for r in collocations(docs, least=50).collect())
    assert got == _brute([(text, "en")], 50, 2000)
    assert words_of(b"A b.C\td") == [b"a", b"b", b"\xff", b"c", b"d", b"\xff"]


def test_parts_overlap(monkeypatch):
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 0, 3, 3, 3, 3, 3, 3, 0], np.int64)
    every = np.full(1, 255, np.uint8)

    def counts(size, shortest):
        monkeypatch.setattr(module, "CHUNK_WORDS", size)
        found = Counter()
        for s, _ in module.Round(shortest, 5, 1, 1, every, every).suffixes("en", ids, [b"\xff", b"a", b"b", b"c"]):
            for row in zip(*[c.tolist() for c in s.columns], s.weight.tolist(), strict=True):
                found[row[:-1]] += row[-1]
        return found

    for shortest, n in ((1, 14), (2, 12), (3, 10)):
        assert counts(1 << 20, shortest) == counts(3, shortest) == counts(1, shortest) and sum(counts(2, shortest).values()) == n

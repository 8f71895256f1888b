"""Repeats and near copies against brute force, and odd inputs."""

import hashlib
import random

import numpy as np

from karvan.llm import near_dedup, substring_dedup
from karvan.llm.groups import word_hashes


def _words(rng, n):
    return ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def _corpus(rng):
    shared = [_words(rng, n) for n in (50, 60, 130, 49)]
    out = []
    for i in range(60):
        text = _words(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared) + _words(rng, rng.randint(0, 30))
        out.append((i * 3 + 1, " ".join(text), f"s{i % 4}"))
    return [*out, (500, out[3][1], "s1"), (501, "ha " * 200, "s2"), (502, "ha " * 120, "s2")]


def _cut_brute(rows, n=50):
    first = {}
    texts = sorted((i, t.encode().split()) for i, t, _ in rows)
    for i, w in texts:
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_repeats_match_brute_force(documents):
    rows = _corpus(random.Random(3))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_spans(documents(rows)).collect()}
    assert got == _cut_brute(rows)
    assert sum(n for _, n, _ in got.values()) > 1000


def test_cut_texts_keep_columns_and_clean_texts(documents):
    rows = _corpus(random.Random(4))
    want = _cut_brute(rows)
    docs = documents(rows)
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == want[r.doc_id][2]
        assert want[r.doc_id][1] or r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text)


def test_repeats_of_odd_inputs(odd_documents, documents):
    rows = substring_dedup.repeated_spans(odd_documents).collect()
    assert len(rows) == 12
    assert sorted(r.n_removed for r in rows if r.doc_id == 7) == [200]
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]
    assert substring_dedup.repeated_spans(documents([])).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    items = near_dedup.mix64(np.arange(1, 401, dtype=np.uint64))
    wa, wb = (rng.uniform(0.5, 3, 400).astype(np.float32) for _ in range(2))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    agree, total = 0, 0
    for r in range(60):
        shifted = items ^ np.uint64(r * 7919)
        both = near_dedup.band_keys(np.r_[shifted, shifted], np.r_[wa, wb], np.array([0, 400]))
        agree += int((both[0] == both[1]).sum())
        total += both.shape[1]
    assert abs((agree / total) ** (1 / near_dedup.ROWS) - want) < 0.05


def _near_brute(rows):
    sets = {i: np.unique(near_dedup.shingles_of(t.encode()), return_counts=True) for i, t, _ in rows}
    distinct = {}
    for i, t, _ in sorted(rows):
        distinct.setdefault(t, i)
    df = {}
    for i in distinct.values():
        for s in sets[i][0].tolist():
            df[s] = df.get(s, 0) + 1
    weights = {i: dict(zip(s.tolist(), near_dedup.tf_idf(n, np.array([df[x] for x in s.tolist()]), len(distinct)), strict=True)) if len(s) else {} for i, (s, n) in sets.items()}
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and weights[a] and weights[b]:
                shared = sum(min(w, weights[b][s]) for s, w in weights[a].items() if s in weights[b])
                if shared / (sum(weights[a].values()) + sum(weights[b].values()) - shared) >= 0.8:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_classes_match_brute_force(documents):
    rng = random.Random(9)
    rows, i = [], 1
    for _ in range(12):
        base = _words(rng, 150)
        for _ in range(rng.choice((1, 2, 5, 9))):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 9))):
                text[rng.randrange(150)] = rng.choice(("qq", "ww", "vv")) + str(rng.randrange(99))
            rows.append((i, " ".join(text), "a"))
            i += rng.randint(1, 4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == _near_brute(rows)
    assert len(set(got.values())) < len(got)


def test_near_copies_of_odd_inputs(odd_documents, documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == 12
    assert (classes[7], classes[8], classes[None]) == (6, 6, None)
    assert [classes[i] for i in (1, 2, 3, 4, 5, 9, 10)] == [1, 2, 3, 4, 5, 9, 10]
    kept = near_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 10]
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_word_hashes_are_stable():
    assert word_hashes([b"a", b"b"]).tolist() == word_hashes([b"a", b"b"]).tolist()

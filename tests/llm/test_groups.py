"""Fingerprint helpers."""

import numpy as np

from karvan.llm import groups


def test_rolling_names_equal_runs_and_only_those():
    h = groups.word_hashes(b"a b c d e a b c x e".split())
    for n in (1, 2, 3, 5):
        r = groups.rolling(h, n)
        runs = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
        assert len(r) == len(runs)
        assert [[a == b for b in r] for a in r] == [[a == b for b in runs] for a in runs]
    assert len(groups.rolling(h, 11)) == 0


def test_packing_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert (groups.unpack_sorted(groups.pack_sorted(v), np.uint32) == v).all()
    w = np.array([-5, 0, 2**60], np.int64)
    assert (groups.unpack(groups.pack(w), np.int64) == w).all()
    assert len(groups.unpack(groups.pack(w[:0]), np.int64)) == 0

"""Quality by attention over passages (multiple-instance learning).

Every text is cut into passages of 64 words. Each passage is encoded from its surface statistics
by a small layer; gated attention, learned from document labels only, weighs the passages; the
weighted passage representation is scored. A text is judged by the passages that tell, wherever
they stand and however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import mix64
from karvan.llm.groups import FACTORS
from karvan.llm.html_text import STOP_WORDS
from karvan.llm.linear import sigmoid
from karvan.llm.toxicity import training_rows

PASSAGE, SAMPLE_ROWS, SLICE_BYTES = 64, 12_000, 4 << 20
HIDDEN, GATE = 16, 8
#: Byte classes: 0 other, 1 space, 2 upper, 3 lower, 4 digit, 5 sentence marks, 6 shout, 7 symbols, 8 bars and brackets, 9 outside ASCII.
CLASSES = 10
_class = np.zeros(256, np.uint8)
for _n, _chars in ((1, b" \t\n\v\f\r"), (2, bytes(range(65, 91))), (3, bytes(range(97, 123))), (4, b"0123456789"), (5, b".,;:?'\"-"), (6, b"!"), (7, b"#$%&*+=@^~\\_"), (8, b"|<>[]{}()/"), (9, bytes(range(128, 256)))):
    _class[list(_chars)] = _n
FEATURES = CLASSES + 11


def _word_keys(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole word: a polynomial of its bytes, from running sums."""
    powers = np.cumprod(np.full(len(buf), FACTORS[0]))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers)]
    back = np.cumprod(np.full(len(buf), np.uint64(pow(int(FACTORS[0]), -1, 1 << 64))))
    return mix64((sums[start + length] - sums[start]) * back[start] ^ length.astype(np.uint64))


def _stop_keys() -> np.ndarray:
    words = [w.encode() for w in sorted(STOP_WORDS)]
    length = np.array([len(w) for w in words])
    return np.sort(_word_keys(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.r_[0, length[:-1]]), length))


STOPS = _stop_keys()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages per text); a text without words has one empty passage."""
    buf = np.frombuffer(b" " + b" ".join(t + b" " for t in texts) + b" ", np.uint8)
    kind = _class[buf]
    space = kind == 1
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = 1 + np.cumsum(np.r_[0, [len(t) + 2 for t in texts[:-1]]]) if texts else np.zeros(0, int)
    words = np.diff(np.r_[np.searchsorted(start, begins), len(start)])
    count = np.maximum(1, -(-words // PASSAGE))
    out = np.zeros((int(count.sum()), FEATURES), np.float32)
    if not len(start):
        return out, count
    text = np.repeat(np.arange(len(texts)), words)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(np.r_[0, words[:-1]]), words)
    passage = np.repeat(np.cumsum(np.r_[0, count[:-1]]), words) + nth // PASSAGE
    first = np.flatnonzero(nth % PASSAGE == 0)
    which, size = passage[first], np.diff(np.r_[first, len(start)]).astype(np.float32)
    length = end - start
    bytes_in = np.add.reduceat(length, first).astype(np.float32)
    at = start[first]
    for c in range(CLASSES):
        out[which, c] = np.add.reduceat((kind == c).astype(np.int32), at) / bytes_in
    key = _word_keys(buf, start, length)
    again = np.r_[False, (key[1:] == key[:-1]) & (text[1:] == text[:-1])]
    lowered = _word_keys(np.where(kind == 2, buf + 32, buf), start, length)
    stop = STOPS[np.minimum(np.searchsorted(STOPS, lowered), len(STOPS) - 1)] == lowered
    last = kind[end - 1]
    per_word = (again, stop, kind[start] == 2, (last == 7) | (last == 8), last == 6, last == 5, length > 12, length == 1)
    for i, flag in enumerate(per_word):
        out[which, CLASSES + i] = np.add.reduceat(flag.astype(np.int32), first) / size
    seen = np.unique((passage.astype(np.uint64) << np.uint64(36)) | (key >> np.uint64(28)))
    out[:, CLASSES + 8] = np.bincount((seen >> np.uint64(36)).astype(np.int64), minlength=len(out))
    out[which, CLASSES + 8] /= size
    out[which, CLASSES + 9] = bytes_in / size / 10
    out[which, CLASSES + 10] = np.log1p(size) / 4
    return out, count


def _slices(texts: list[str]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class AttentionModel:
    """h = relu(xW + b); gate e = (tanh(hV) * sigmoid(hU))w; a = softmax(e); score = sigmoid(sum(a h)c + d)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
        self.mean, self.spread = mean, spread
        self.p = {k: rng.normal(0, 1 / np.sqrt(max(s[0], 1)), s) if len(s) else np.zeros(()) for k, s in shape.items()}
        self.p["b"] = np.full(HIDDEN, 0.1)

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, first = self.p, np.cumsum(np.r_[0, count[:-1]])
        owner = np.repeat(np.arange(len(count)), count)
        x = (x - self.mean) / self.spread
        h = np.maximum(x @ p["W"] + p["b"], 0)
        tv, su = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (tv * su) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first)
        return sigmoid(z @ p["c"] + p["d"]), (x, h, tv, su, a, z, owner, first)

    def gradient(self, y: np.ndarray, count: np.ndarray, score: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, h, tv, su, a, z, owner, first) = self.p, kept
        err = (score - y) / len(y)
        dz = err[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[owner])
        dg = de[:, None] * p["w"]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh = (a[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T) * (h > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ de, "c": z.T @ err, "d": err.sum()}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.01, batch: int = 256, l2: float = 1e-4, seed: int = 7) -> AttentionModel:
        rng, t = np.random.default_rng(seed), 0
        first = np.cumsum(np.r_[0, count[:-1]])
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs) + rate / 20
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                chosen = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in chosen])
                score, kept = self.forward(x[rows], count[chosen])
                t += 1
                for k, g in self.gradient(y[chosen], count[chosen], score, kept).items():
                    g = g + l2 * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AttentionModel:
    """Fit on at most ``rows`` labelled texts that are not held out; their features reach the driver."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, at = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), 0
            for part in _slices(batch.column("text").to_pylist()):
                x, count = passages(part)
                cuts = np.split(x, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(part)], pa.int64()), pa.array(ys[at : at + len(part)], pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["doc_id", "y", "x"])
                at += len(part)

    seen = training_rows(docs, labels, "quality", rows).mapInArrow(encode, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    xs = [np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in seen["x"].to_pylist()]
    if not xs:
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES))
    x, count = np.concatenate(xs), np.array([len(v) for v in xs])
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3)
    return model.fit(x, count, seen["y"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: AttentionModel, name: str = "score") -> DataFrame:
    """Add the probability of a good text. A null or empty text is one passage without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.forward(*passages(part))[0] for part in _slices(list(texts))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0), dtype="float64")

    return docs.withColumn(name, score("text"))

"""Toxicity by weak supervision.

Many voters (word lists, word-stem lists, style patterns) look at each document of a bounded
training sample. A generative label model explains their votes by one hidden label: it learns
every voter's accuracy and which voters are correlated (a tree of pairwise dependencies), by
expectation maximisation. Its posterior labels train a linear classifier over hashed words and
stems, and that classifier scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.common import held_out, text_column
from karvan.llm.linear import fit_logistic, sigmoid, telling

LETTERS = re.compile(r"[^\W\d_]+")
#: Most labelled rows used for fitting, chosen by a digest of their id.
SAMPLE_ROWS = 12_000
DIMS = 1 << 18
#: Lengths of the word stems used as features.
STEMS = (4, 5, 6, 7)
#: The most frequent stems among the markers are voters of their own.
SINGLES = 24
#: A marker occurs in at least so many toxic documents, nearly only there.
MARKER_DOCS, MARKER_PURITY, MARKERS = 6, 0.95, 600
#: A general lexicon; one voter by itself.
LEXICON = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool imbecile garbage filthy vermin hate kill".split()
STYLE = (re.compile(r"[!?]{2,}"), re.compile(r"\b[^\W\d_]{2,}(?<![a-zà-ÿ])\b"), re.compile(r"[%$&*#]{3}"))
_hashes: dict[str, tuple[int, ...]] = {}


def words_of(text: str) -> set[str]:
    """Distinct words of a text: runs of letters, lower case, whatever the language."""
    return set(LETTERS.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """A word and its stems, marked apart."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]


def feature_ids(word: str) -> tuple[int, ...]:
    found = _hashes.get(word)
    if found is None:
        if len(_hashes) > 60_000:  # bounds the memory of a worker, not the work
            _hashes.clear()
        found = _hashes[word] = tuple(zlib.crc32(f.encode()) % DIMS for f in features_of(word))
    return found


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents that are not held out.

    The first by a digest of the id; null ids and labels other than 0 and 1 are no labels. Copies
    of a text are no further evidence: they are one row with the smallest id and the label that
    most of them have (0 when as many have each), so the rows do not depend on the partitioning.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_in = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers
    return rows_in.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") > 0.5).cast("int").alias("y")).select("doc_id", "text", "y")


def mine_markers(sample: DataFrame) -> list[str]:
    """Words and stems that tell toxic from other training documents, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(text_column(batch), batch.column("y").to_pylist(), strict=True):
                hits[y].update({f for w in words_of(text) for f in features_of(w)})
            names = list(hits[0].keys() | hits[1].keys())
            yield pa.RecordBatch.from_pydict({"f": names, "pos": pa.array([hits[1][f] for f in names], pa.int64()), "neg": pa.array([hits[0][f] for f in names], pa.int64())})

    counts = sample.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pure = counts.where((F.col("pos") >= MARKER_DOCS) & (F.col("pos") >= MARKER_PURITY * (F.col("pos") + F.col("neg"))))
    return [r.f for r in pure.orderBy(F.desc("pos"), "f").limit(MARKERS).collect()]


def voters(markers: list[str]) -> list[frozenset[str]]:
    """The general lexicon, one voter for each frequent stem, one list for each kind of the rest."""
    shorter = set(markers)
    stems = [m for m in markers if m[0] != "=" and f"{int(m[0]) - 1}{m[1:-1]}" not in shorter][:SINGLES]  # not those a shorter marker covers
    rest = [m for m in markers if m not in set(stems)]
    return [frozenset(f"={w}" for w in LEXICON), *(frozenset([m]) for m in stems), *(frozenset(m for m in rest if m[0] == k) for k in ("=", *map(str, STEMS)))]


def votes_of(text: str, words: set[str], lists: list[frozenset[str]]) -> list[int]:
    """One vote per voter: 1 = sees signs of toxicity, 0 = sees none, 2 = abstains (no words)."""
    if not words:
        return [2] * (len(lists) + len(STYLE))
    found = {f for w in words for f in features_of(w)}
    return [int(not found.isdisjoint(x)) for x in lists] + [int(len(p.findall(text)) > len(words) / 10) for p in STYLE]


class LabelModel:
    """P(votes, y) with one table per voter given y and the voter it depends on most.

    ``anchor`` holds the known label of some rows and -1 for all others; it ties the hidden label
    to the meaning of the labels. ``accuracy[j]`` is P(vote j agrees with y), ``parent[j]`` the
    correlated voter (-1: none).
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, anchor: np.ndarray, rounds: int = 25, floor: float = 0.02) -> None:
        n, m = votes.shape
        q = np.where(anchor >= 0, anchor, np.clip(start, 0.02, 0.98)).astype(float)
        one_hot = np.eye(3)[votes]
        for _ in range(rounds):
            w = np.stack([1 - q, q])
            self.prior = np.clip(w.sum(1) / max(n, 1), 1e-3, None)
            pair = np.einsum("yn,nia,njb->yijab", w, one_hot, one_hot) if n else np.zeros((2, m, m, 3, 3))
            single = np.einsum("yiiaa->yia", pair)
            self.parent = self._tree(pair, single, floor)
            self.tables = []
            for j, p in enumerate(self.parent):
                counts = pair[:, p, j] if p >= 0 else np.repeat(single[:, j][:, None], 3, 1)
                counts = counts + 0.1 * (single[:, j] + 0.1)[:, None] / (single[:, j].sum(-1) + 0.3)[:, None, None]  # back off to no parent
                self.tables.append(counts / counts.sum(-1, keepdims=True))
            self.accuracy = np.array([(single[0, j, 0] + single[1, j, 1]) / max(single[:, j, :2].sum(), 1e-9) for j in range(m)])
            q = np.where(anchor >= 0, anchor, self.posterior(votes))

    @staticmethod
    def _tree(pair: np.ndarray, single: np.ndarray, floor: float) -> list[int]:
        """Spanning forest over pairs whose votes share over ``floor`` nats given y."""
        total = max(single[:, 0].sum(), 1e-9) if single.shape[1] else 1.0
        joint = pair / total + 1e-9
        a = single / total + 1e-9
        of_y = a.sum(-1)[:, :1]
        share = (joint * np.log(joint * of_y[:, :, None, None, None] / (a[:, :, None, :, None] * a[:, None, :, None, :]))).sum((0, 3, 4))
        m = share.shape[0]
        parent, reached = [-1] * m, set()
        for root in range(m):
            if root in reached:
                continue
            reached.add(root)
            while True:
                best = max(((share[i, j], i, j) for i in reached for j in range(m) if j not in reached), default=(0, -1, -1))
                if best[0] <= floor:
                    break
                parent[best[2]] = best[1]
                reached.add(best[2])
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[:, None].repeat(len(votes), 1)
        for j, p in enumerate(self.parent):
            log += np.log(self.tables[j][:, votes[:, p] if p >= 0 else np.zeros(len(votes), int), votes[:, j]])
        return sigmoid(log[1] - log[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights of the classifier; at most ``rows`` rows of feature ids reach the driver."""
    sample = training_rows(docs, labels, "toxic", rows)
    lists = voters(mine_markers(sample))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, ids = [], []
            for text in text_column(batch):
                words = words_of(text)
                votes.append(votes_of(text, words, lists))
                ids.append(sorted({i for w in words for i in feature_ids(w)}))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int8())), pa.array(ids, pa.list_(pa.int32())), batch.column("y"), batch.column("doc_id")], ["votes", "ids", "y", "doc_id"])

    seen = sample.mapInArrow(look, "votes array<tinyint>, ids array<int>, y int, doc_id long").toArrow().sort_by("doc_id")
    if seen.num_rows == 0:
        return np.zeros(DIMS, np.float32), -3.0
    votes, known = np.array(seen["votes"].to_pylist(), np.int64), seen["y"].to_numpy()
    anchor = np.where(np.arange(len(known)) % 2 == 0, known, -1)  # half the labels; votes alone speak for the rest
    q = LabelModel(votes, np.where((votes[:, : len(lists)] == 1).any(1), 0.9, 0.05), anchor).posterior(votes)
    ids = [x.values.to_numpy() for x in seen["ids"].combine_chunks()]
    return fit_posterior(ids, q)


def fit_posterior(ids: list[np.ndarray], q: np.ndarray) -> tuple[np.ndarray, float]:
    """The linear classifier, on features that tell the posterior labels apart."""
    keep = telling(ids, q, DIMS, least_rows=MARKER_DOCS, least_z=6.0)
    return fit_logistic([x[keep[x]] for x in ids], q, DIMS, steps=150, rate=0.1, l2=1e-5)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """Add the probability of a toxic text. Null and empty texts have no words: the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats, whatever the data

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for text in texts:
                z = bias
                for w in words_of(text or ""):
                    s = known.get(w)
                    if s is None:
                        if len(known) > 150_000:
                            known.clear()
                        s = known[w] = float(weights[[zlib.crc32(f.encode()) % DIMS for f in features_of(w)]].sum())
                    z += s
                out.append(float(sigmoid(np.float64(z))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(name, score("text"))

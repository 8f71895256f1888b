"""Encoding whole texts to piece ids, and decoding them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karvan.llm.piece_lattice import MODEL, lattice

N_BEST = 3
ENCODED = "ids array<int>, n_pieces long, others array<array<int>>, scores array<double>, round_trip boolean"
OWN = ("ids", "n_pieces", "others", "scores", "round_trip")
#: Ids in an outgoing batch, of the best segmentations alone.
BATCH_IDS = 1 << 20


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32, copy=False)))


def encode_texts(docs: DataFrame, keep: list[str], n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """The ``keep`` columns with ``ids, n_pieces, others, scores, round_trip``.

    ``ids`` is the best segmentation of the whole text and ``others`` are the rest of its ``n`` best
    in order (fewer where there are fewer), as lists of ids; ``scores`` are the log probabilities of
    all of them; ``round_trip`` says that decoding every one gave the text again. A null text is an
    empty one: no ids. Columns of these names in the input are replaced.
    """
    keep, limit = [c for c in keep if c not in OWN], BATCH_IDS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(model, n)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a in range(0, len(texts), 500):  # bounds an outgoing batch
                own = [t or "" for t in texts[a : a + 500]]
                found = coder.n_best_of(own)
                same = [coder.decode(best[0][1].tolist()) == t and all(coder.alike(best[0][1], ids) for _, ids in best[1:]) for best, t in zip(found, own, strict=True)]
                size = np.array([len(best[0][1]) for best in found])
                cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                    some = found[x:y]
                    others = _lists([ids for best in some for _, ids in best[1:]])
                    ends = pa.array(np.cumsum([0, *[len(best) - 1 for best in some]]).astype(np.int32))
                    columns = [
                        _lists([best[0][1] for best in some]),
                        pa.array(size[x:y].astype(np.int64)),
                        pa.ListArray.from_arrays(ends, others),
                        pa.array([[score for score, _ in best] for best in some], pa.list_(pa.float64())),
                        pa.array(same[x:y]),
                    ]
                    part = batch.slice(a + x, y - x)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *OWN])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(encode, f"{kinds}, {ENCODED}" if kinds else ENCODED)


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Add ``text``, decoded from ``ids``; null ids give a null text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = lattice(model, 1)
        for batch in batches:
            yield pd.Series([None if x is None else coder.decode(list(x)) for x in batch], dtype="object")

    return encoded.withColumn("text", decode("ids"))

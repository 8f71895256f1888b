import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text, source) with the usual columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 20_000))
    copy = " ".join(words(rng, 200))
    near = copy.split()
    near[100] = "zzz"
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (5, long, "a"), (6, copy, "a"), (7, copy, "b"), (8, " ".join(near), "c"), (None, copy, "a"), (9, "a b c d", None), (10, "x y z w v", "b"), (10, "x y z w v", "b")]
    return documents(rows)

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, key string, n long"


@pytest.fixture(scope="session")
def docs(spark):
    """A function from texts (or (doc_id, text) rows) to a documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", "k", 7) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    def make(n, seed=0, vocabulary=400):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]

    return make

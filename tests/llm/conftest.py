import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, label string, h long"


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "x", 0.5, "y", 1) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def rng():
    return random.Random(11)

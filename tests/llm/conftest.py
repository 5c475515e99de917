"""Small tables for the corpus operators."""

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A function from texts, or pairs of doc_id and text, to a documents table."""

    def make(rows, more=""):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture
def words():
    """A function that makes a text of n words of a vocabulary."""

    def make(n, seed, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make

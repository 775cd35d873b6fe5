from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "sk", "lt", "")]


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def make_prose(rng):
    return lambda n: prose(rng, n)


def docs_of(spark, rows, extra: bool = False):
    """documents of (doc_id, text); with ``extra`` also columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    if extra:
        schema += ", id long, bucket string, seg string, comp string, root string, spans string, sig string, `a.b` string"
        data = [(*r, 5, *["x"] * 7) for r in data]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows, extra=False: docs_of(spark, rows, extra)

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, root string"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd(spark, vocabulary):
    """Documents with nulls, blanks, ties, repeated rows, a long text and clashing columns."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    rows = [(i, t, "en", s, 1, 0.5, i, "x") for i, (t, s) in enumerate([
        (base, "a"), (base, "a"), (base.upper(), "b"), (base + " extra", None), (" ".join(base.split()[:118]), "b"), (None, "a"), ("", "a"), (" \n\t", None),
        ("one two", "b"), ("One  two", "b"), ("one two three four five", "a"), (text(30000), "a"), ("x" * 50_000, "c"), (text(80) + "\n" + text(5) + "\n" + base, "c"),
    ])]
    rows += [rows[0], rows[8], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)


def collected(df, *order):
    return df.orderBy(*[F.col(c) for c in order]).collect()

from __future__ import annotations

import random

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and an extra column with a clashing name."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "Straße", "日本語", "don't", "x.y", "!!"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "s1", 27, "e"),
        (1, "one two three four five six", "en", "s1", 27, "e"),
        (2, None, "en", None, None, None),
        (3, "", None, "s2", 0, "e"),
        (4, long, "de", "s2", len(long), "e"),
        (5, long, "de", "s3", len(long), None),
        (None, "text without an id", "en", "s1", 18, "e"),
        (None, None, None, None, None, None),
        (7, " \n\t \n", "fr", "s4", 5, "e"),
        (8, "12345 !!! ***", "fr", "s4", 13, "e"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string")

"""Small tables with everything awkward in them."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, host int, row string, score double, word string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ne", "su")) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text) with nulls, empty and blank texts, ties, repeated rows and a very long text."""
    rng = random.Random(3)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "single"),
        (8, "two words"),
        (None, base),
        (None, None),
        (9, words(rng, 4000)),
        (10, "naïve Ünï çödé " * 5),
        (11, "the same the same the same the same"),
        (-5, words(rng, 80)),
        (12, base.upper()),
        (13, "1234 5678"),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 50))) for i in range(25)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame([(i, t, None if i is None else "en", "s", None, "k", 1, "r", 0.5, "w") for i, t in awkward_rows], DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)

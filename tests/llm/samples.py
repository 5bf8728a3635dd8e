"""Rows that the tests of this folder share; the session is that of the other tests."""

import random

import pytest

from vitrina.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Invented prose, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.randrange(300)}" for _ in range(n)) + "."


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def corpus():
    """Rows with the awkward cases: nulls, empty and long texts, copies, near copies, repeated rows, ties."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 1), (4, None, None, None, None),
        (5, "", "en", "a", 0), (6, " \n\t ", "en", "b", 4), (7, "one", "en", "", 3), (8, "one", "en", None, 3),
        (9, "two words", "en", "c", 9), (10, prose(2, 3000), "en", "a", 1), (11, prose(3, 40) + "\n" + base[:400], "de", "c", 1),
        (None, prose(4, 50), "en", "a", 1), (None, None, "en", "a", 1), (12, prose(5, 50), "en", "a", 1),
        (12, prose(5, 50), "en", "a", 1), (13, "x" * 700, "en", "d", 700), (14, "y" * 450 + " " + "x" * 650, "en", "d", 1),
        (15, "Ünïcödé ñandú 日本語 text. \n Second  line\n\nthird 'tis it's 12 3a", "en", "e", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, size string, node string, label string, key string, _id string, _row string"


def prose(seed: int, words: int, stem: str = "") -> str:
    rng = random.Random(seed)
    return " ".join(stem + "".join(rng.choice(["ta", "ri", "mo", "ke", "lu", "so", "pa"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns have names that operators use."""
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, *["x"] * 8) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in all columns, empty, blank and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 80), "en", "a"), (2, prose(2, 80), "en", "b"), (2, prose(3, 70), None, None), (3, None, "en", "a"),
        (4, "", "fr", "b"), (5, " \n\t ", "fr", "c"), (6, long, "en", "a"), (7, "é" * 5000, None, "c"), (8, "one two", "fr", "a"),
        (None, prose(4, 60), "en", None), (None, None, None, None), (9, prose(5, 90), "fr", "b"), (9, prose(5, 90), "fr", "b"),
        (10, "12 34 !!", "en", "a"), (-5, prose(6, 55), "en", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return documents(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def none_at_all(spark):
    return documents(spark, [])

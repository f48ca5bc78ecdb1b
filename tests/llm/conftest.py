import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, size int, part int, hits string, shard string, row string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    passage = words(70, 1)
    rows = [
        (5, words(80, 2) + " " + passage, "en", "b"), (3, passage + "\n" + words(200, 3), "en", "a"), (9, passage.upper() + "  " + passage, None, "a"), (3, passage + "\n" + words(200, 3), "en", "a"),
        (None, words(80, 2) + " " + passage, "en", None), (None, None, None, None), (7, None, "fr", "a"), (8, "", "en", "b"), (10, " \t\n ", "en", "b"), (11, "é " * 60 + "żółć ☃", "fr", "c"),
        (12, words(30_000, 4), "en", "c"), (13, words(29_000, 4) + " x", "en", "c"), (14, "one two", "en", "c"), (15, "one two", "en", "c"), (16, "la " * 300, "en", "a"), (17, passage, "en", "d"),
    ]
    return spark.createDataFrame([(*r, 1, 2, "h", "s", "r") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

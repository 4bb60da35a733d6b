import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, kind="en"):
    """Words of invented syllables; languages differ in theirs."""
    parts = {"en": ["th", "er", "on", "ing", "wh"], "de": ["sch", "ung", "keit", "ü", "ein"], "fr": ["eau", "é", "oi", "que", "ment"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rng = random.Random(7)
    long = prose(rng, 20_000)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, None),
        (3, " \t\n ", "en", "a", 3),
        (4, long, "en", "b", len(long)),
        (5, prose(rng, 120), "en", "a", 1),
        (5, prose(rng, 120), "en", "a", 1),
        (None, prose(rng, 80, "de"), "de", "b", 1),
        (7, "same text here " * 40, "fr", "b", 1),
        (7, "same text here " * 40, "fr", "b", 1),
        (8, "1234 5678 !!!", "de", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 documents of three languages with copies and near copies."""
    rng, rows = random.Random(3), []
    for i in range(300):
        kind = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, rng.randint(20, 200), kind), kind, f"src{i % 7 if i % 3 else 0}", 0))
    for i in range(300, 340):
        words = rows[i - 300][1].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), rows[i - 300][2], "src0", 0))
    return spark.createDataFrame(rows, DOCS)

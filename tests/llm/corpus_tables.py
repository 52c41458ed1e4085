"""Tables that the tests of the corpus operators share."""

import random

import pytest

#: Names that the operators use inside; extra columns of these names must not disturb them.
CLASHING = ("key", "number", "size", "rank", "label", "score", "y", "weight", "row", "words", "of", "hits")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGES = [
    (5, None, "en", "b", 0),
    (1, "", None, None, 0),
    (2, " \t\n ", "en", "b", 4),
    (3, "word", "en", "a", 4),
    (4, "Released under the MIT License. mit license", "en", "a", 43),
    (9, "The same old text of some words, again and again.", "en", None, 49),
    (7, "The same old text of some words, again and again.", "en", "c", 49),
    (7, "The same old text of some words, again and again.", "en", "c", 49),
    (None, "Nobody's text with a dozen words that are in no other document at all", "en", "c", 70),
    (8, "déjà vu — ünïcode ſtraße 東京 \U0001f600 İstanbul", "fr", "a", 36),
    (6, "x" * 50_000 + " long " * 3_000, "de", "a", 68_000),
]


@pytest.fixture(scope="session")
def edges(spark):
    frame = spark.createDataFrame(EDGES, SCHEMA)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def prose(seed: int, words: int = 60, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose with exact and near copies, in three sources; the first has most of it."""
    rows = []
    for i in range(120):
        text = prose(i // 3 if i % 3 else i)
        if i % 6 == 5:
            words = text.split()
            words[7] = "changed"
            text = " ".join(words)
        rows.append((i, text, "en", "abc"[0 if i % 4 else i % 3], len(text)))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)

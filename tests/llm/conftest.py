import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, characters beyond ASCII."""
    long = prose(1, 30_000)
    token = "q8ZtR2mVx0LpK5sWn7YbHc3JdFg9TzQe1UaXo4Ni"
    some = prose(2, 120)
    return [
        (1, some, "en", "a", 5),
        (1, some, "en", "a", 5),
        (2, some + " more", "en", "a", None),
        (3, None, "en", "a", 0),
        (4, "", None, "b", 0),
        (5, " \t\n ", "fr", None, 3),
        (None, prose(3, 80), "en", "a", 1),
        (None, None, None, None, None),
        (6, long, "en", "b", 9),
        (7, "été " * 40 + "### $$$ <|end|> \\ 😀", "fr", "b", 2),
        (8, f"key {token} and password = {'x1' * 9} AKIA{'Q7' * 8} end", "en", "b", 3),
        (8, "the same id with another text, MIT-License", "en", "b", 3),
        (9, "one two", "de", "c", 7),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


#: Names that results of the operators use, as extra columns of their input.
CLASHES = ("n_words", "size", "target", "taken", "copies", "spans", "base_spans", "class_id", "labels", "places", "score", "kept", "base_failed", "lang_pred", "accepted", "rule", "verdict", "host", "path", "key", "id", "hash", "bands", "element", "item_id", "word", "cut", "budget", "term", "form", "root", "n", "near", "part", "item", "value", "rank", "start", "ids", "tie", "chunk", "counts")


@pytest.fixture
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("clash").alias(c) for c in CLASHES])

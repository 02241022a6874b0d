import random

import pytest

SYL = ["th", "er", "on", "an", "re", "he", "ou", "ing", "tion", "ea", "st", "nd"]


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randint(1, 3)))


def text(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and an extra column with a clashing name."""
    rng = random.Random(5)
    base = text(rng, 60)
    words = base.split()
    near = " ".join(words[:30] + ["changed"] + words[31:])
    rows = [
        (0, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "x"), (2, near, "en", None, None, "x"), (3, None, None, "a", 0, None), (4, "", "en", "a", 0, None),
        (5, "one", "en", "a", 3, None), (6, "Two Words", "en", "a", 3, None), (7, text(rng, 9000), "en", "b", 5, None), (8, "###  \n\t 123", "en", "b", 5, None),
        (9, text(rng, 40) + "\n" + base[:200] + "\n" + text(rng, 30), "fr", "b", 5, None), (9, text(rng, 12), "fr", "b", 5, None), (10, "straße Ünïcode 日本語 😀 <|endoftext|> don't", "de", "b", 5, None),
        (None, base, "en", "b", 5, None), (11, "x" * 300 + " " + text(rng, 5), "en", "b", 5, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


SF = "/root/testdata/sf0.001"

import random

import pytest

WORDS = "the of and in to river stone Amber kettle longer window paper Éclair über naïve garden seven token winter".split()


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", "\n", ", ", ". "]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and texts, clashing names."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a", 1), (2, "", None, None, None), (3, " \t\n", "en", "a", 3), (4, "one", "en", "a", 4),
        (5, shared, "en", "a", 5), (6, shared, "en", "a", 6), (6, shared, "en", "a", 6), (7, prose(rng, 80) + shared + prose(rng, 9), "fr", "b", 7),
        (8, long, "en", "a", 8), (9, long[:5000] + "X" + long[5000:], "en", "a", 9), (None, shared, "en", "a", 10), (None, prose(rng, 70), None, "a", 11),
        (10, "AAAA " * 400, "en", "a", 12), (11, "same line that is long enough\n" * 3, "en", "a", 13), (12, "  SAME line that is long enough\t\nother", "en", "a", 14),
        (13, "same line that is long enough", "en", "a", 15), (14, "漢字🙂 é́ İ \x1c x\x00y <|endoftext|> Σ", "zh", "a", 16),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").withColumnsRenamed({"source": "_text"})


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)

import pytest

DOCS = "doc_id long, text string, lang string, score double, spans string, n_words long, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names clash with added ones."""
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", 1.0, "x", 1, "h"),
        (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", None, None, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", 1.0, "x", 1, "h"),
        (5, "   \n\t ", "en", 1.0, "x", 1, "h"),
        (6, "one", "en", 1.0, "x", 1, "h"),
        (7, words, "en", 1.0, "x", 1, "h"),
        (8, words + " more", "en", 1.0, "x", 1, "h"),
        (9, "x" * 100_000, "en", 1.0, "x", 1, "h"),
        (9, "x" * 100_000, "en", 1.0, "x", 1, "h"),
        (None, "a row without an id but with some words", "en", 1.0, "x", 1, "h"),
        (11, "naïve 日本語 🦄 token = 'abcdefghijkl12' mail a.b@c.de", "en", 1.0, "x", 1, "h"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

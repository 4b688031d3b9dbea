import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double, row int"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    words = " ".join(f"w{i} thing{i % 7}" for i in range(30))
    rows = [
        (None, None, None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (1, "", "en", "a", 0, 1, "k", 0.5, 1),
        (2, words, "en", "a", 3, 2, "k", 0.5, 1),
        (2, words, "en", "a", 3, 2, "k", 0.5, 1),
        (3, words, None, None, 3, 2, None, None, None),
        (4, "x " * 150_000, "en", "b", 4, None, "k", 0.5, 1),
        (5, "é\u00a0ß\n\n\r\n \t", "fr", "b", 5, 3, "", 0.0, 0),
        (6, "single", "de", "", 6, 3, "", 0.0, 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

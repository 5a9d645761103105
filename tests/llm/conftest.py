import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, n long, root int"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names that operators use."""
    rows = [
        (1, None, "en", "a", None, "b", 1, 2),
        (2, "", None, "a", 0, None, None, None),
        (3, "one two", "en", None, 7, "b", 1, 2),
        (None, "no id but some words of text here", "en", "a", 33, "b", 1, 2),
        (5, LONG, "en", "a", len(LONG), "b", 1, 2),
        (6, "the same text twice, word for word", "en", "a", 34, "b", 1, 2),
        (6, "the same text twice, word for word", "en", "a", 34, "b", 1, 2),
        (7, "the same text twice, word for word", "en", "a", 34, "b", 1, 2),
        (8, "12345 67890 !!! ---", None, "a", 19, "b", 1, 2),
        (9, " \t\n\r ", "en", "a", 5, "b", 1, 2),
        (10, "émile é ñandú 𝒳 🙂 ẞ", "fr", "a", 17, "b", 1, 2),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)

import pytest


def make_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, white space, repeats, ties, a long text, no valid id."""
    return make_docs(
        spark,
        [
            (1, None, "en", "s", None),
            (2, "", None, "s", 0),
            (3, " \t\n ", "en", None, 4),
            (4, "One two", "en", "s", 7),
            (4, "One two", "en", "s", 7),
            (5, "ONE TWO", "en", "s", 7),
            (None, "no id here at all", "en", "s", 1),
            (None, None, None, None, None),
            (6, "word " * 30000, "en", "s", 150000),
            (7, "x" * 50000, "en", "s", 50000),
            (8, "café \U0001f600 naïve <|endoftext|> 123", "fr", "s", 20),
        ],
    )

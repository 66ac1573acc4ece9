import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the thing and the other thing of it. " * 20_000


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, ties, and repeated rows."""
    rows = [
        (1, "The same text here.", "en", "a", 3), (2, "The same text here.", "en", "a", 3),
        (2, "The same text here.", "en", "a", 3), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, "The same text here.", "en", "b", 3), (None, None, None, None, None), (5, " \t\n ", "de", "a", 4),
        (6, LONG, "en", "a", 7), (7, LONG + "x", "en", "a", 7), (8, "der die das und nicht", "de", "a", 1),
        (8, "another text of the same id", "en", "a", 1), (9, "12 34 !!", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def clashing(odd_docs):
    """Further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "th", "fp", "key", "row", "row_id", "_id", "_source", "score", "lang_pred", "n_tokens",
             "start", "length", "words", "raw", "root", "keep_id", "kept"]
    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])

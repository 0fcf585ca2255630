import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names clash with results."""
    long = "\n".join(f"line {i} of a very long text with several words in it" for i in range(3000))
    rows = [
        (1, "alpha beta gamma delta " * 8, "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \n\t ", "de", "s2", 0), (5, "one", None, "s2", 3),
        (6, "alpha beta gamma delta " * 8, "en", "s1", 1), (6, "alpha beta gamma delta " * 8, "en", "s1", 1), (7, long, "de", None, 9), (None, "no id here at all", "en", "s1", 5), (8, "x" * 5000, "fr", "s3", 2),
    ]
    wide = [(*r, "k", 7, 8, 9, 1.5, "d", "r") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int, block int, n_words int, score double, drop string, _row string")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")

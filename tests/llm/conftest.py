import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those used inside."""
    long = " ".join(f"w{i}" for i in range(30_000))
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, text), (6, text), (7, text + " tail"), (7, text + " tail"), (8, long), (9, "x " * 400), (None, text), (10, "é" * 300), (11, "ONE Two"), (12, long + " end")]
    return spark.createDataFrame([(i, t, None, None, None, "b", "w") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(45))
    rows = [
        (1, f"alpha beta {passage} gamma", "en", "a", "x", 1, 0.5),
        (2, f"delta {passage} epsilon zeta", None, "a", "x", 2, None),
        (3, None, "en", None, None, None, None),
        (None, "a text without an id but with words enough to be a line", "de", "b", "y", 3, 1.0),
        (4, "", "en", "a", "x", 4, 1.0),
        (5, " \n\t\n ", "en", "a", "x", 5, 1.0),
        (6, long, "fr", "a", "x", 6, 1.0),
        (7, "repeated row of several plain words here", "en", "a", "x", 7, 1.0),
        (7, "repeated row of several plain words here", "en", "a", "x", 7, 1.0),
        (8, "one", "en", "a", "x", 8, 1.0),
        (9, "é" * 20_000, "fr", "a", "x", 9, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n long, score double")

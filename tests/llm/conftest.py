import pytest


@pytest.fixture(scope="session")
def long_text():
    return " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture
def odd_docs(spark, long_text):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, None, "x", 0.5), (2, "", None, None), (3, long_text, "y", 1.0), (4, "same text here, and a little more of it", "z", 0.1), (4, "same text here, and a little more of it", "z", 0.1), (5, "same text here, and a little more of it", "w", 0.2), (None, "no id", "v", 0.3), (6, "  \n\n ", "u", 0.4)]
    return spark.createDataFrame(rows, "doc_id long, text string, rule string, score double")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, rule string, score double")

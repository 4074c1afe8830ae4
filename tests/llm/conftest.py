import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a clashing extra column."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "k"),
        (2, None, None, "k"),
        (3, "", "en", None),
        (4, "a" * 5000 + " " + "xyzzy" * 4000, "en", "k"),
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "k"),
        (None, "no id at all", "de", "k"),
        (6, "  two   spaces\n\n \t tabs é中文 \U0001f600 don't I'll 12345 \n ", "fr", "k"),
        (7, "x y\nx y\n\nx y\n \n", "en", "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, key string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

import pytest

# Nulls in every column, empty and long texts, repeated rows, clashing names.
LONG = "Long words stand here. " * 6000
ROWS = [
    (1, "A short text.", "en", "a", 13, "x", 1),
    (1, "A short text.", "en", "a", 13, "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 2),
    (4, LONG, "en", "b", len(LONG), "x", 3),
    (5, " \t\n \x0b\f\r ", "de", "b", 8, "x", 4),
    (None, "No id but words.", "de", None, 16, "x", 5),
    (7, "ÀÉ 漢字 🙂 e\u0301 \x1c odd\x1fspaces", "fr", "c", 20, "x", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, label long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

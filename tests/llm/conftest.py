import pytest

LONG = "word " * 60_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
    (None, "A text without any number of its own stands here", "en", None), (4, LONG, "en", "b"), (5, "!!! ... ???", "de", "b"), (6, "x" * 30_000, "fr", "c"), (7, "ÀÉ ñandú 東京 \t\r\n  q", "es", "c"),
    (8, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (9, "one", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, further columns named like the operators' own."""
    rows = [(*r, i, 0.5, "x", True, "y") for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, severity double, host string, rejected boolean, component string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def more():
    """Labelled documents of a larger table, in a fixed random order, as pandas."""
    import duckdb

    d = "/root/testdata/sf0.1"
    return duckdb.sql(f"SELECT d.*, quality, toxic FROM '{d}/documents.parquet' d JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").df()

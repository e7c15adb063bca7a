import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size string, line string, vertex string, name string, segment string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like those of the operators."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here", "en", "a"), (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here", "en", "a"),
        (2, "Alpha  beta gamma\tdelta epsilon zeta. Second line here", "en", "b"), (None, "Alpha beta gamma delta epsilon zeta.\nSecond line here", None, None),
        (None, None, None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "de", None), (6, long, "en", "a"), (7, long + " end", "en", None),
        (8, "two words", "fr", "b"), (9, "Two words", "fr", "b"), (10, "12 34 !!", "de", "c"), (11, "ünïcode ſtrange Ⅷ text here", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None, "1", "x", "y", "z", "n", "s") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated rows, a repeated id, and columns whose names results use."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and then it sleeps. " * 3, "en", "a", 1), (1, "The quick brown fox jumps over the lazy dog and then it sleeps. " * 3, "en", "a", 1),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 3), (None, "a text without an id that goes on for a while", "en", "b", 5), (None, None, None, None, None),
        (5, LONG, "en", "c", 9), (6, LONG + " tail", "en", "c", 9), (7, "ÉTÉ Straße 中文 \U0001f600 x" * 9, "fr", "c", 9), (7, "other text of the same id, which is not like the first one at all", "en", "c", 9), (8, "word", "en", "d", 4),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in ("kept", "score", "n_tokens", "shard", "key", "size", "ids", "id", "label", "draw", "rep", "part", "_dropped_id")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, None), (5, 0, 1), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

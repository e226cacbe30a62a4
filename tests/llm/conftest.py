import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet, consectetur " * 20_000


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like our own."""
    names = ["doc_id", "text", "lang", "row", "key", "n_words", "Score", "items"]
    rows = [
        (1, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a", 1, 7, 0.5, ["x"]),
        (1, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a", 1, 7, 0.5, ["x"]),
        (2, "the quick brown fox jumps over the lazy dog by the river bank today", None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 2, 8, 0.1, []),
        (5, " \n\t ", "en", "b", 2, 8, 0.1, []),
        (None, "no id here but some words to read", "en", "c", 3, 9, 0.2, []),
        (None, None, None, None, None, None, None, None),
        (6, LONG, "la", "d", 4, 1, 0.3, []),
        (7, "x" * 300_000, "en", "d", 4, 1, 0.3, []),
        (8, "ÉTÉ ß 漢字 🙂 \\ # < </turn> ### ok", "fr", "e", 5, 2, 0.4, []),
    ]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType())]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

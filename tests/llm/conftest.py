import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("size", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("text_key", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("hash", T.StringType()), T.StructField("kept", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) tuples, with clashing extra columns."""

    def make(rows):
        full = [
            (*(list(r) + [None] * (4 - len(r))), None, "a", "b", "c", "d", None, "e") for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties and a very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    plain = "The quick brown fox jumps over the lazy dog near the river bank today"
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, plain, "en", "a"),
        (4, plain, "en", "a"), (5, plain, None, "b"), (6, plain.upper(), "en", None),
        (None, plain, "en", "b"), (None, None, None, None), (7, long_text, "en", "c"),
        (8, long_text + " tail", "en", "c"), (9, "ünïcödé ß 日本語 текст", "xx", "c"), (10, "12345 !!!", "en", "c"),
        (11, "x", "en", "b"), (12, "one two\tthree  four", "en", "b"), (13, "one two three four", "en", "b"),
    ]


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

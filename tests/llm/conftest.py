import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    words = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = [
        (1, "the cat sat on the mat and the dog ran to the park with a ball " * 5, "en", "a", 1, 5),
        (2, "the cat sat on the mat and the dog ran to the park with a ball " * 5, "en", "b", 2, 5),
        (2, "the cat sat on the mat and the dog ran to the park with a ball " * 5, "en", "b", 2, 5),
        (3, "", None, None, None, None),
        (4, None, "en", "a", 3, 0),
        (None, "short text", "en", "a", 4, 1),
        (None, None, None, None, None, None),
        (5, words, "en", "c", 5, 2),
        (6, words + " tail", None, "c", 6, 2),
        (7, " \t\n\r ", "fr", "d", 7, 2),
        (8, "Ünïcödé 日本語 🎉 words\nline\nline\n  two  spaces\tand tabs", "de", "d", 8, 3),
        (-9, "short text", "en", "e", 9, 3),
        (10, "x", "en", "e", 10, 3),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("uid", T.LongType()), ("n", T.LongType()))])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

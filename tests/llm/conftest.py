import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("shard", T.StringType()), T.StructField("hub", T.StringType()), T.StructField("fp", T.StringType()),
])

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees near water"


def rows(*texts, start=0, source="s"):
    return [(i + start, t, "en", source, 1, "k", 1, 0.5, "x", "h", "f") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(data):
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    data = rows(BASE, BASE, "", None, "a", "word " * 30_000, BASE + " extra", "é" * 10, start=1)
    data += [data[0], (None, "no id", None, None, None, None, None, None, None, None, None), (None, None) + (None,) * 9, (77, None) + (None,) * 9, (1, "other text, same id", "en", None, 1, "k", 1, 0.1, "x", "h", "f")]
    return make_docs(data)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])

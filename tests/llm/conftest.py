import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("score", T.DoubleType()), T.StructField("hits", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("shard", T.IntegerType()),
])

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 997} token{i}" for i in range(30_000))
    rows = [
        (1, LINE, "en", "a", 10), (2, LINE, "en", "a", 10), (2, LINE, "en", "a", 10), (3, LINE.upper(), None, None, None),
        (4, "", "en", "b", 0), (5, None, "de", "b", 0), (6, " \t\n ", "de", None, 4), (7, "ein wort", "de", "c", 8),
        (8, long, "en", "c", 1), (9, long + " end", "en", "a", 1), (None, "without an id", None, None, None),
        (None, None, None, None, None), (10, "12 34 !!", "en", "b", 8), (11, "é ñ ü " * 40, "de", "c", 1), (12, "ein wort", "de", "c", 8),
    ]
    return spark.createDataFrame([(*r, 0.5, "h", 1, "k", 3) for r in rows], DOC).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)

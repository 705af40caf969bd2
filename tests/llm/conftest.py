import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names may clash."""
    long = "word " * 20_000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "s1", 1), (1, "Alpha beta gamma delta epsilon zeta", "en", "s1", 1), (2, "Alpha beta gamma delta epsilon zeta", None, "s2", None),
        (3, None, "en", "s1", None), (4, "", "en", None, 0), (None, "no id here at all", "en", "s1", 3), (None, None, None, None, None), (5, long, "en", "s2", 9), (6, "   ", "de", "s2", 1), (7, "é ü ß 日本 " * 9, "de", "s2", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"__text": F.lit("x"), "size": F.lit(1), "fp": F.lit(2), "__score": F.lit(0.5), "shard": F.lit(3), "__k1": F.lit(1), "id": F.lit(4), "h": F.lit(5), "words": F.lit("w"), "rate": F.lit(1.5), "__id": F.lit(2)})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark: SparkSession):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "a b c d e f " * 9000, "en", "s"), (4, "hello world"), (4, "hello world"), (None, "x y z", None, None), (6, "é \n ü", "de", "t"), (7, " \t\n ", "en", "s")]
    extra = docs(rows)
    for name in ("n", "k", "t", "sid", "row", "size", "g", "rank", "bucket", "token", "score", "held_out", "_text_", "taken"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra

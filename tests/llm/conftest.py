import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and a column that looks like an operator's own."""
    long_text = " ".join(f"word{i % 977} and the {i % 53}" for i in range(20_000))
    plain = "The quick brown fox jumps over the lazy dog while the old man reads his paper near the quiet river bank. " * 6
    rows = [
        (1, None, "en", "src0", 0, 1.0),
        (2, "", "en", "src0", 0, None),
        (3, long_text, "en", None, len(long_text), 2.0),
        (4, plain, "en", "src1", len(plain), 2.0),
        (4, plain, "en", "src1", len(plain), 2.0),
        (None, plain.upper(), None, None, None, None),
        (5, " \n\t ", None, "src1", 4, 0.0),
        (6, "a" * 5000, "xx", "src1", 5000, 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))

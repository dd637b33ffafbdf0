import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(5000)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty, blank and long texts, repeated
    rows, and extra columns whose names clash with those that operators add."""
    long = " ".join(WORDS[i % 5000] for i in range(30000))
    rows = [
        (1, "Hello world of mine", "en", "src0", 19),
        (1, "Hello world of mine", "en", "src0", 19),
        (2, None, None, None, None),
        (3, "", "en", "src0", 0),
        (4, " \t\n", "de", "src1", 3),
        (None, "no id here at all", "en", "src1", 17),
        (5, long, "en", "src2", len(long)),
        (6, "12 34 !!", None, "src2", 8),
        (7, "Ünïcödé ßtraße \U0001f600 text", "de", "src3", 22),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("lang_pred", "secret_spans", "words", "tokens", "score", "node", "bucket", "media", "main_text", "width"):
        df = df.withColumn(c, F.lit("x"))
    return df

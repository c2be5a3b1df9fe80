import pytest

EDGE = [
    (1, "", "en", "s1"), (2, None, None, None), (3, "   \n\t", "fr", "s1"), (4, "one two three four", "en", "s2"), (5, "one two three four", "en", "s2"),
    (6, "ONE two THREE four", None, "s1"), (7, "x" * 50_000, "en", "s3"), (8, "word " * 20_000, "en", "s3"), (9, "ünï çödé <|endoftext|> <|startoftext|> 'S don't", "fr", "s1"),
    (9, "ünï çödé <|endoftext|> <|startoftext|> 'S don't", "fr", "s1"), (None, "no id here at all today", "en", "s1"), (10, "password = hunter2hunter2 and token:abc", "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("key", "kept", "row", "score", "component", "signature", "size", "s", "found"):
        df = df.withColumn(name, F.lit("clash"))
    return df

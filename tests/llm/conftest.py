import pytest

HARD = [
    (0, "Hello World one two three four five six"), (1, "hello world ONE two three four five six"), (2, ""), (3, None), (4, "   \n\t "), (5, "Élan élan ÉLAN"), (6, "élan élan Élan"),
    (7, "word " * 30_000), (8, "word " * 30_000), (9, "x"), (None, "Hello World one two three four five six"), (None, None), (9, "x"), (10, "<|endoftext|> a\x00b  c\n\nd \n e"), (11, "日本語のテキスト🙂 mixed"), (12, "a" * 50_000),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty, blank, very long and repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("digest", "keep_id", "range", "rep", "score", "_shard", "n", "root", "ids", "task", "extra", "bucket", "norm", "kept")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")

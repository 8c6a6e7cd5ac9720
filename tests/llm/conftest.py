import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    prose = "The quick brown fox jumps over the lazy dog while seven wizards mix potions and forty more words follow here to make it long enough for every rule"
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, prose + " indeed"), (4, " \n\t \n"), (5, long), (6, "one two"), (7, "ONE two"), (8, prose), (9, "a\n\na\na  b \n"), (10, "é ñ 漢字 \u0000 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["score", "predicted", "n_words", "kept", "w", "h", "token", "key", "pos", "item_id", "tokens", "label", "n_dropped", "held_out"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

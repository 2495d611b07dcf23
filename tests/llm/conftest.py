import pytest
from pyspark.sql import Row  # noqa: F401

NASTY = [
    (1, "The quick brown fox.\nSame line here\n\tSAME line here \n"), (2, None), (3, ""), (4, "   \n\n  "),
    (5, "naïve café ﬁne İstanbul ΣΑΣ  x y 東京タワー 😀 é \x1c \x85 it's we'll 'S"),
    (6, "a" * 30000), (7, "word " * 20000), (8, "<|endoftext|> a<|startoftext|>b <|endoftext|>"),
    (9, "The quick brown fox.\nSame line here\n\tSAME line here \n"), (9, "other text of the same id"),
    (9, "other text of the same id"), (None, "no id at all"), (None, None), (-5, "negative id"), (10, "\r\n\x0b\x0c tabs\t\t"),
    (2**62, "huge id 12345 67 8 9.10"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, repeated ids and rows, columns with clashing names."""
    rows = [(i, t, "en", "x", 1, 2, "b") for i, t in NASTY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, "
                                       "block int, data string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

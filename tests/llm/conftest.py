"""Small tables with every awkward case."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 5000}x{k % 7}" for k in range(30_000))
ITEM = "one two three four five six seven eight nine ten eleven twelve"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "fr", "b", 5),
    (6, LONG, "en", "a", len(LONG)),
    (7, f"Prefix words {ITEM.upper()} and a tail", "en", "c", 5),
    (8, "Mail me at john.smith@mail.example.com or 10.0.0.255, card 4111 1111 1111 1111, call +1 (555) 123-4567.", "en", "c", 9),
    (9, "é" * 50 + " ünïcödé ðocument 日本語 😀 x@y.zz", "fr", "a", 60),
    (10, "!!! ### ***", None, "a", 11),
    (11, "a" * 60_000, "en", "d", 60_000),
    (12, "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4 +12 34567890 5 4111-1111-1111-1112", "en", "d", 3),
]


@pytest.fixture(scope="session")
def docs(spark):
    """With a repeated row, and columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*ROWS, ROWS[0], (None, "no id here at all", "en", "a", 3)], DOCS)
    extra = ("size", "words", "node", "id", "a", "b", "n", "spans", "base", "text_hash", "anchors", "score", "target", "block", "level")
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (3, None, "a"),
    (4, "", "b"),
    (5, "   \n\t ", None),
    (6, LONG, "b"),
    (7, "one two", "b"),
    (7, "one two", "b"),
    (None, "a row without an id but with some words in it, and more of them", "a"),
    (8, "Line one of the document is here\nLine one of the document is here\nItem 12 of 40 was sold on day 7\nñandú 日本語 🙂", "c"),
    (9, "Item 99 of 41 was sold on day 12\nAnother line that only this document has", "c"),
]
#: Extra columns whose names operators also use.
EXTRA = "n_tokens int, ids string, shard string, slot int, score string, kept string, size int, code string, n int, block int"


@pytest.fixture(scope="session")
def docs(spark):
    values = [(*r, *[None] * 9, 0) for r in ROWS]
    return spark.createDataFrame(values, f"doc_id long, text string, source string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

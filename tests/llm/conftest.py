import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, __x string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = ("the quick brown fox " * 3000 + "\n") * 2
    rows = [
        (1, "Hello world, token = 'abcdef12345'", "en", "a", 34, 7, "x"),
        (1, "Hello world, token = 'abcdef12345'", "en", "a", 34, 7, "x"),
        (2, None, None, None, None, None, None),
        (None, "bonjour le monde", "fr", None, 16, None, None),
        (None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 1, ""),
        (4, long, "en", "b", len(long), 1, ""),
        (5, long, "en", None, len(long), 1, ""),
        (6, "123 456 !!!", None, "c", 11, 1, ""),
        (7, "\n\n \t\x0b\n", "de", "c", 6, 1, ""),
        (8, "▁ 🙂 <|endoftext|> é", "de", "c", 19, 1, ""),
        (9, "und die der das einer und die der das einer", "de", "c", 43, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

import pytest

EXTRA = "extra string, n_shingles string, size string, sketch string, score string"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    base = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again", "en", "a"),
        (3, "", "en", None),
        (4, None, None, "b"),
        (5, long, "fr", "b"),
        (6, " \t\n ", "fr", "b"),
        (7, "été\r\n日本語テキスト 🙂 <|endoftext|> x", "de", "é"),
        (None, "a row without a number", "en", "a"),
        (8, "x" * 20_000, None, "a"),
        (9, "123 456", "en", "a"),
    ]
    rows = [(*r, "e", "clash", "clash", "clash", "clash") for r in base]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, {EXTRA}")

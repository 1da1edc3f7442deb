import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls anywhere, empty and long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 0, "x"),
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 0, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "y"),
        (4, "   \n\t ", None, "b", 3, "y"),
        (None, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "z"),
        (5, long_text, "en", "b", len(long_text), "z"),
        (6, long_text + " end", "en", "b", len(long_text), "z"),
        (7, "мир 你好 🎉 a@b.co +1 (555) 555-0100 x", "ru", None, 5, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")

import pytest


@pytest.fixture(scope="session")
def small(spark):
    """Documents with every odd row: nulls, empty and blank texts, copies, a very long text, clashing columns."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog. " * 8, "a"),
        (2, "The cat sat on the mat and looked at the dog. " * 8, "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \t\n ", "b"),
        (6, "one two three", "b"),
        (7, "One  two\nTHREE", "c"),
        (8, long, "a"),
        (9, long + " tail", "a"),
        (9, long + " tail", "a"),
        (None, "no id here at all, friend", "c"),
        (11, "émoji 😀 漢字 <|endoftext|> don't\r\n\r\n  x", "c"),
    ]
    return spark.createDataFrame(
        [(d, t, s, -1, "old", "kept") for d, t, s in rows],
        "doc_id long, text string, source string, n_words long, labels string, draws string",
    )

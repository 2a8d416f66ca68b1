import re

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents with all columns, and extra ones whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, row string, n_words int")

    return make


@pytest.fixture(scope="session")
def words():
    return lambda text: re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten " * 4
    return [(1, None, "a"), (2, "", None), (3, " \n\t\n", "a"), (4, long, "b"), (5, same, "b"), (6, same, "a"),
            (6, same, "a"), (7, "word", None), (8, "é漢🙂 x\r\ny", "b"), (9, "x" * 5000, "c")]

"""Fixtures and plain versions that the tests share."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew an unusually strong potion of moonlight and thyme"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names clash with results; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "no") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty and blank texts, copies, repeated rows, one very long text, ids out of order."""
    long_text = " ".join(f"w{i % 977}" for i in range(40_000))
    return docs_of([
        (5, None, None), (3, "", "a"), (9, "  \n", "a"), (2, PROSE, "b"), (7, PROSE.upper(), "b"), (7, PROSE.upper(), "b"), (1, long_text, "a"),
        (None, "no id here", "c"), (12, "one", None), (11, "Ünïcode Straße 中文 😀 end", "c"), (4, PROSE + " and more", "b"),
    ])


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    return text.translate(UP)

"""A frame of documents with nulls, empty and long texts, ties and clashing column names."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def made(texts, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOC)

    return made


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, long, "fr", "b", len(long)), (3, long, "fr", "b", len(long)), (None, "text without an id", "xx", None, 1), (4, "x" * 5000, "en", "a", 5000)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOC + ", row long, measures long, spans long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """docs(rows of (doc_id, text)): a documents table; lang and source follow the id."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], SCHEMA)

    return make


#: null, empty, blank, no letters, very long, repeated
ODD = [(None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "123 !!!"), (5, "word " * 60_000), (6, "same text here"), (6, "same text here"), (7, "same text here")]


@pytest.fixture
def odd():
    return list(ODD)

import pytest


@pytest.fixture
def documents(spark):
    """Makes a table of documents from texts, or from (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(i, r, "en", "s", len(r or "")) if not isinstance(r, tuple) else (*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make

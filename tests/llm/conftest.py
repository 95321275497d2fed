import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table with clashing extra columns, from (doc_id, text) pairs."""

    def make(rows, **columns):
        full = [(i, t, None, "s", None, 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, value string")

    return make

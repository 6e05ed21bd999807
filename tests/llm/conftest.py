import pytest

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents, all from one source; extra column names clash with those operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "s", "en", 0) for i, t in rows], DOCS)

    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, items string"


@pytest.fixture
def documents(spark):
    """Makes a documents table with columns that clash with names the operators use."""

    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t) if t is not None else None, 0.5, 7, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empties, repeats and clashing column names."""

    def make(texts, langs=None, sources=None, ids=None):
        n = len(texts)
        rows = [(ids[i] if ids else i, t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t) if t is not None else None, "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, key string")

    return make

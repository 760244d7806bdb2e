import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(texts, schema="doc_id long, text string"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make

import pytest


@pytest.fixture
def docs(spark):
    """A maker of document tables: rows of (doc_id, text), with further columns under names that operators use themselves."""

    def make(rows):
        full = [(i, t, "xx", "src", 0, "clash", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component_id string, length int")

    return make

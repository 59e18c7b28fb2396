import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with columns that clash with inner names."""

    def make(*rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", "y", 7) for r in rows]
        return spark.createDataFrame(full, DOCS + ", count string, key string, n long")

    return make

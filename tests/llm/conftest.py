import pytest


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source, n_chars) and further columns with names that operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, label string, _m string, h int, n long, c0 string, _removed int"
        full = [(i, t, lang, src, None if t is None else len(t), "x", None, 1, 2, "y", 3) for i, t, lang, src in rows]
        return spark.createDataFrame(full, schema)

    return make

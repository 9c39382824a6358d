import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, payload string, html string, _host string, _rank long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text[, lang])`` with extra columns of clashing names."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "x", "y", "z", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

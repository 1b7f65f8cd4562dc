import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table of documents, with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", len(t or ""), k, k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENTS + ", row long, size long")

    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string"


@pytest.fixture
def make_docs(spark):
    """Documents with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, "x") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

import pytest


@pytest.fixture
def docs(spark):
    """A maker of documents tables with an extra column whose name clashes with
    the operators' own: rows of (doc_id, text[, lang, source])."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, kept boolean"
        full = [(r[0], r[1], *(r[2:] or ("en", "s0")), len(r[1] or ""), "x", None) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}

import pytest


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="0.001": spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table documents with the given (doc_id, text) rows."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, s, "en", "src1", None if s is None else len(s)) for i, s in rows], schema)

    return make

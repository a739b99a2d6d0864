import pytest
from pyspark.sql import Row


@pytest.fixture()
def docs_of(spark):
    """A documents table of (doc_id, text) with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, "y") for i, t in rows],
            "doc_id long, text string, th string, pos int, label string",
        )

    return make


ROW = Row

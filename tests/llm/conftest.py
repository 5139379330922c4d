import pytest


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents with every odd case: nulls, empty and long texts, ties,
    repeated rows, and an extra column whose name clashes with an internal one."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, _n long")
    return make

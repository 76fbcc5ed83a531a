import pytest

from tallyloom.llm.queries import on_workers

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox " * 30_000


@pytest.fixture(autouse=True)
def workers(spark):
    on_workers(spark)


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like results."""
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "alpha beta gamma delta"), (4, LONG), (5, "x"), (6, " \n\t ")]
    clash = "n_shingles long, component_id long, kept boolean, score double, ids string, spans string, base string, held_out string"
    return spark.createDataFrame([(*r, 0, 0, False, 0.5, "", "", "", "") for r in rows], f"doc_id long, text string, {clash}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

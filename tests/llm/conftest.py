import pytest

from pictorium.llm.common import BATCH_BYTES

from .samples import noise, prose


@pytest.fixture()
def documents(spark):
    """Documents with names that operators use themselves."""

    def make(*rows):
        rows = [(i, t, "row", 0, 0, "x", 1.0) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, row string, kept int, n int, body string, score double")

    return make


@pytest.fixture()
def odd_documents(documents):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    base = prose(1, 80)
    return documents(
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (None, base), (None, None), (6, "   "),
        (7, prose(2, BATCH_BYTES // 40)), (8, noise(3, 400)), (9, "one two"), (10, "ONE two"), (11, base + " more"),
    )

import pytest


@pytest.fixture
def table(spark):
    """Documents with nulls, empty and long texts, repeats, and columns with clashing names."""

    def make(texts, **more):
        rows = [(None if t == "no id" else i, t, "en", "src0", len(t or ""), "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, quillon_extra string")

    return make


ODD = [None, "", " \n\t", "one", "Two words", "x" * 5000, "é" * 900, "a b c d e f g", "a b c d e f g", "No letters: 123!"[11:]]

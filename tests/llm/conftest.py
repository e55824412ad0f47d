import pytest


@pytest.fixture
def make_docs(spark):
    """Documents with columns that clash with names used inside the operators."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source if not isinstance(source, list) else source[k], None if t is None else len(t), 1, "x", 2) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, key int, bucket string, row int"
        )

    return make

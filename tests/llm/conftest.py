import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts or (doc_id, text) pairs, with the other columns and one of a clashing name."""

    def make(rows, langs=None, **extra):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        langs = langs or ["en"] * len(pairs)
        data = [(i, t, lang, "src", None if t is None else len(t), 1) for (i, t), lang in zip(pairs, langs)]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int").repartition(3)

    return make

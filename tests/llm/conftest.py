import pytest

PROSE = "the thing about these lines is that they go on and on with plain words in them " * 3
FIELDS = (
    "doc_id long, text string, lang string, source string, n_chars long, `limit` string, _key string, key string, "
    "text_hash string, size long, kept string, lang_pred string"
)


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, "x", "y", "z", "w", 7, "k", "p")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, clashing columns."""
    rows = [
        _row(1, PROSE), _row(1, PROSE), _row(2, PROSE), _row(3, None), _row(4, ""), _row(None, PROSE), _row(None, None, None, None),
        _row(5, "word " * 30_000), _row(6, "x" * 40_000), _row(7, PROSE + "one more"), _row(8, "12 34 !!"), _row(9, "a"),
        _row(10, "día ñandú " * 40, "es", None), _row(11, PROSE, None, "b"), _row(9, "another text under the same id"),
    ]
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (7, 1, 0), (None, 1, 0), (5, 0, 1), (5, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

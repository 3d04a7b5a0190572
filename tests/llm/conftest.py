import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text[, lang, source]); two further columns have names the operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), 7, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null and empty texts, a null id, repeated rows, white space, a very long text."""
    return docs_of([(1, "a b  c\td e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (5, " \n "), (6, "word " * 60000), (7, "A B C D E F")])

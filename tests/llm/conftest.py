import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (doc_id, text[, source]) tuples."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return make


#: Texts that every operator has to take.
ODD = [None, "", " ", "a", "ü" * 300, "word " * 5000, "\x00\t\n\r\x0b\x0c", "日本語テキスト " * 40, "😀 smile", "x" * 20000, "word " * 5000, None, "the quick brown fox jumps over the lazy dog " * 8]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


#: Nulls, nothing, white space, other scripts, one character, repeated rows, and a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "日本語 テキスト"), (6, "same text here"), (6, "same text here"), (None, "no id"), (8, "😀 é ́\x00\x1c\x85 end"), (9, "long " * 40_000)]


@pytest.fixture
def odd(docs):
    return docs(ODD)

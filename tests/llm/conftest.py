import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with the operators' own names."""
    def build(rows):
        extra = ", ".join(f"{c} string" for c in ("fp", "score", "key", "first", "line", "words"))
        return spark.createDataFrame(
            [(i, t, "en", "s", None, *"abcdef") for i, t in rows], f"{DOCS}, {extra}")
    return build


def edge_rows():
    """Null ids and texts, empty and blank texts, repeated rows, and one very long text."""
    return [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c"),
            (4, "a b c"), (5, "ünï cödé   x"), (6, "w" * 50_000), (7, "x y " * 30_000),
            (8, "tail")]

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, fp long, a long, chunk string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows as documents, with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", 1, 2, 3, "c") for i, t, lang in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, null and repeated ids, repeated rows, one very long word and one long text."""
    long = " ".join(f"word{n % 700} and" for n in range(15_000))
    return [(1, None, None), (2, "", "en"), (None, "some words with a null id", "en"), (3, "the same text twice", "en"), (3, "the same text twice", "en"), (4, "x" * 3000, "de"), (5, long, "en"), (6, "  two  spaces \t\n end ", "en"), (7, "literal ▁ mark, 日本語 and \U00010348 letters", None), (8, "12345 !!! ---", "fr")]

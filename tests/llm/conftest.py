import pytest

LONG = "x" * 60_000  # one very long word
MANY = "alpha beta gamma delta " * 15_000  # many words

# names that the operators use inside
CLASHING = ["row", "fp", "shard", "slot", "score", "words", "number", "chunk", "label", "draw", "_key", "candidate", "n"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing ids and texts, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "Another text with the same id as the first one has.", "en", "a"),
        (2, None, "en", None),
        (None, "A row without an id, of some length and words.", None, "b"),
        (None, None, None, None),
        (3, "", "en", "a"),
        (4, "  \t\n ", "en", "a"),
        (5, LONG, "en", "a"),
        (6, MANY, "en", "a"),
        (7, "ünïcode ① 日本語 \U0001f600 ſtraße", "de", "b"),
        (8, "12345 !!! ###", "de", "b"),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(*r, *["?"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        rows = [(first + i, t, "en", "src") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    return make

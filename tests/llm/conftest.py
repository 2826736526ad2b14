import pytest

#: A text longer than any limit that a step could have.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    data = [
        (1, "the same text of a few words here", "en", "a", 33),
        (2, "the same text of a few words here", "en", "b", 33),
        (2, "the same text of a few words here", "en", "b", 33),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "a row without an id but with words", "en", "c", 1),
        (9007199254740993, LONG, "en", "a", len(LONG)),
        (9007199254740994, LONG + " end", "en", "b", len(LONG)),
        (7, " \t\n ", "en", "a", 4),
        (8, "é中\U0001f600 mixed   scripts", "fr", "c", 1),
    ]
    names = "id text_ node copies kept own_id spans mixed_id h pos source_size".split()
    df = spark.createDataFrame(data, DOCS)
    for n in names:
        df = df.selectExpr("*", f"doc_id as {n}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("tables absent")
    return path

import pytest

LONG = "word " * 30_000

TEXTS = [
    (1, "The cat sat on the mat and looked at the dog for a long time today."),
    (2, "The cat sat on the mat and looked at the dog for a long time today."),
    (3, None),
    (4, ""),
    (5, "   \t "),
    (6, "12345 +++ 678"),
    (7, LONG),
    (8, "Der Hund und die Katze sind nicht im Haus, sagt der Mann mit dem Hut.\nZweite Zeile."),
    (None, "a row without an id but with some words in it"),
    (9, "one"),
    (9, "one"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows: nulls in each column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None if t is None else len(t), k, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, token string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

import pytest

# Names that operators use inside: a table may have columns called alike.
CLASHING = "fp long, component_id long, length long, rank long, bucket long, blob string, spans string, words string, score double, label string, n long"


def documents(spark, rows):
    """Documents (doc_id, text) with the other columns of the table and some that clash."""
    full = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 3, 4, 5, "b", "s", "w", 0.5, "l", 6) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two three"), (7, LONG), (8, LONG + " tail"),
    (9, "ünïcödé 日本語 текст 🙂 words and more words here"), (9, "ünïcödé 日本語 текст 🙂 words and more words here"),
    (10, "same id"), (10, "other text of the same id"), (None, "a row without an id"), (None, None), (None, "one"),
    (11, "x" * 50_000), (12, "\x00\x01 control \x1f signs"), (13, "1 2 3 4 5 6 7 8 9"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return documents(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])

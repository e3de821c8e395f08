import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("kept", "score", "node", "uid", "key", "component_id", "size", "at"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def odd():
    """Nulls, empty texts, repeated rows and ids, ties, very long and odd texts."""
    long_line = " ".join(f"w{k}" for k in range(3000))
    return [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one"), (5, "two words here"), (None, "no id at all"),
        (None, None), (7, long_line), (8, long_line + " x"), (9, "É \t\x0b tab\nÇa"), (10, "x" * 5000), (11, "日本語 テキスト"),
    ]

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) to a documents table with columns that clash with inner names."""
    def make(rows, clash=True):
        full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in ("kept", "size", "fp", "low", "n", "metrics", "own", "doc", "at", "words", "component_id", "_kept"):
                df = df.withColumn(name, df["doc_id"])
        return df
    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    prose = "der rote Fuchs läuft durch den alten Wald und sieht viele kleine Tiere am stillen See. " * 8
    return [
        (1, prose, "de", "a"), (2, prose, "de", "a"), (2, prose, "de", "a"), (3, None, "de", "a"), (4, "", None, None),
        (None, prose, None, "b"), (None, None, None, None), (5, "wort " * 40_000, "de", "b"), (6, "  \n\t ", "en", "c"),
        (7, "one two", "en", "c"), (8, "日本語のテキスト🙂 " * 30, "ja", None), (9, "x" * 70_000, "en", "c"),
    ]

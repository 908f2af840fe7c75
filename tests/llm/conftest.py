import pytest


@pytest.fixture
def docs_dir(spark, tmp_path):
    """Write rows as the documents table and give the folder."""

    def write(rows, schema="doc_id long, text string, lang string, source string, n_chars long", labels=None):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
        if labels is not None:
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def small_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and a column whose name clashes."""
    rows = [
        (1, "A plain text. It has two sentences.", "en", "a", 35, "x"),
        (1, "A plain text. It has two sentences.", "en", "a", 35, "x"),
        (2, None, None, None, None, None),
        (None, "no id at all", "en", "b", 12, "y"),
        (None, None, None, None, None, "z"),
        (3, "", "fr", "b", 0, "z"),
        (4, "word " * 20000, "de", "a", 100000, "w"),
        (5, " \n\t ", "es", None, 4, "v"),
        (6, "É " * 30 + "password=abcdefghijkl0123 All rights reserved", "fr", "c", 0, "u"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size string")

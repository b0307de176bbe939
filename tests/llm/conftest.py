import pytest

from tests.conftest import SF_DIR


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(6000))
    rows = [
        (1, "Alpha beta gamma delta.\nSecond line of the text here.", "en", "a", 5),
        (2, "alpha BETA gamma delta.\nSecond line of the text here.", None, "a", 5),
        (2, "alpha BETA gamma delta.\nSecond line of the text here.", None, "a", 5),
        (3, None, "en", None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (None, "a row without an id", None, None, None),
        (6, long, "en", "hot", 7),
        (7, long + " tail", "en", "hot", 7),
        (8, "é ß 😀 Σ", "fr", "hot", 7),
    ]
    extra = [(*r, 9, "z", 1.0, "k") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key long, row string, score double, bucket string"
    return spark.createDataFrame(extra, schema)

import pytest

SCHEMA = "text string, doc_id long, source string, lang string, n_chars long, sid int, n int, token string, whole int, place int, row int, words string"


@pytest.fixture
def docs(spark):
    """Builds a documents table with extra columns of names that operators use inside."""
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, source)."""
        full = [(r[1], r[0], r[2] if len(r) > 2 else "a", "en", None if r[1] is None else len(r[1]), 1, 2, "x", 3, 4, 5, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make

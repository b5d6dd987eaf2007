import pytest

CLASHING = "source string, lang string, n_chars long, length long, sequence_id string, __row int, fp string, size int"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(rows, source="s"):
        full = [
            (d, t, *(x if x else (source, "en")), None, 9, "x", 1, "f", 2)
            for d, t, *rest in rows
            for x in [rest[0] if rest else None]
        ]
        return spark.createDataFrame(full, f"doc_id long, text string, {CLASHING}").repartition(3)

    return make

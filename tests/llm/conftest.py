import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, source]) rows, with extra columns whose names operators use too."""
    from pyspark.sql import functions as F

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        table = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("size", "n", "rep", "key", "label", "kept", "score", "class", "_w"):
                table = table.withColumn(name, F.lit("x"))
        return table

    return make

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """docs((id, text), ..) with the columns of `documents` and one whose name an operator uses itself."""

    def make(*rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, tokens string, label int"
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3, F.col("n_chars"))

    return make

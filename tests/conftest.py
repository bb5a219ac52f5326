import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rowloom.session import remove_written, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "rowloom-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="rowloom-wh-"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    remove_written(spark)
    spark.stop()


@pytest.fixture
def rows(spark):
    """rows("a string, b int", (..), (..)) -> DataFrame, and back with .out(df, "a")."""

    class Rows:
        def __call__(self, schema, *data, parts=1):
            return spark.createDataFrame(list(data), schema).repartition(parts)

        @staticmethod
        def out(df, *columns):
            found = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
            return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))

    return Rows()

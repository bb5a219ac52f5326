"""Write to database tables; Spark commits one transaction per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter

from ..functions.names import names, ref, require
from ..operators.changes import upsert
from ..session import written
from ..sources.jdbc import connection, read_table

BATCH_ROWS = 500


def table_writer(df: DataFrame, url: str, table: str, schema: str | None = None, columns=None, mode: str = "insert",
                 batch_size: int = BATCH_ROWS, **extra) -> DataFrameWriter:
    """The configured writer: insert appends, truncate empties the table first and keeps its definition."""
    if not url or not table:
        raise ValueError("write_table: url and table are required")
    if mode not in ("insert", "truncate"):
        raise ValueError(f"write_table: unknown mode {mode!r}")
    wanted = require(df, names(columns), "write_table")
    out = df.select(*[ref(c) for c in wanted]) if wanted else df
    writer = out.write.format("jdbc").options(
        **{**connection(url), "dbtable": f"{schema}.{table}" if schema else table, "batchsize": str(batch_size),
           **{k: str(v) for k, v in extra.items()}})
    return writer.mode("append") if mode == "insert" else writer.mode("overwrite").option("truncate", "true")


def write_table(df: DataFrame, url: str, table: str, schema: str | None = None, columns=None, mode: str = "insert",
                keys=None, batch_size: int = BATCH_ROWS, read_options: dict | None = None, **extra) -> None:
    """insert, truncate, or upsert by `keys`.

    JDBC has no upsert: the merged table is first written to the shared folder,
    since the table it was read from is emptied next. `read_options` may hold
    partitionColumn, lowerBound, upperBound and numPartitions for that reading.
    """
    if mode == "upsert":
        if not names(keys):
            raise ValueError("write_table: upsert needs keys")
        current = read_table(df.sparkSession, url, table, schema, columns, **{**extra, **(read_options or {})})
        df = written(upsert(current, df, keys), "upsert")
        mode = "truncate"
    table_writer(df, url, table, schema, columns, mode, batch_size, **extra).save()

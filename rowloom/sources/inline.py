"""Small inputs written in the job itself, and the clock."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import delimiter_of


def text_input(spark: SparkSession, data: str, delimiter: str = ",") -> DataFrame:
    """Inline delimited text whose first line is the header; `\\n` may be written out."""
    if not data or not data.strip():
        raise ValueError("text_input: data is required")
    text = data.replace("\\n", "\n")
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter_of(delimiter), skipinitialspace=True) if r]
    header = [h.strip() for h in rows[0]]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    body = [tuple((r + [""] * len(header))[:len(header)]) for r in rows[1:]]
    return spark.createDataFrame(body, schema)


def data_grid(spark: SparkSession, columns, rows) -> DataFrame:
    """A grid of cells, as lists or JSON text; one type per column.

    All numbers give double, all booleans boolean, anything else text.
    """
    def decoded(value, what):
        if not isinstance(value, str):
            return list(value)
        try:
            found = json.loads(value)
        except json.JSONDecodeError as e:
            raise ValueError(f"data_grid: {what} is not valid JSON: {e}") from e
        if not isinstance(found, list):
            raise ValueError(f"data_grid: {what} must be a JSON array")
        return found

    names = [str(c) for c in decoded(columns, "columns")]
    if not names:
        raise ValueError("data_grid: columns are required")
    cells = [list(r) for r in decoded(rows, "rows")]
    for i, row in enumerate(cells):
        if len(row) != len(names):
            raise ValueError(f"data_grid: row {i} has {len(row)} cells, expected {len(names)}")

    def text(value):
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False)

    fields = []
    for i, name in enumerate(names):
        present = [r[i] for r in cells if r[i] is not None]
        if present and all(isinstance(v, bool) for v in present):
            fields.append(T.StructField(name, T.BooleanType()))
        elif present and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in present):
            fields.append(T.StructField(name, T.DoubleType()))
            for r in cells:
                r[i] = None if r[i] is None else float(r[i])
        else:
            fields.append(T.StructField(name, T.StringType()))
            for r in cells:
                r[i] = text(r[i])
    return spark.createDataFrame([tuple(r) for r in cells], T.StructType(fields))


def clock(spark: SparkSession) -> DataFrame:
    """One row with the current time and its parts."""
    now = F.current_timestamp()
    return spark.range(1).select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("datetime"), F.date_format(now, "yyyy-MM-dd").alias("date"),
        F.date_format(now, "HH:mm:ss").alias("time"), F.year(now).cast("bigint").alias("year"),
        F.month(now).cast("bigint").alias("month"), F.dayofmonth(now).cast("bigint").alias("day"),
        F.hour(now).cast("bigint").alias("hour"), F.minute(now).cast("bigint").alias("minute"),
        F.second(now).cast("bigint").alias("second"), F.unix_seconds(now).alias("unix"),
        F.date_format(now, "EEEE").alias("weekday"),
    )

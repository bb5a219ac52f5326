"""Write delimited text as a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.names import dtype, names, ref, require
from ..functions.parsing import as_text


def write_csv(df: DataFrame, path: str, delimiter: str = ",", append: bool = False, columns=None,
              column_order: str = "sorted", header: bool | None = None, single_file: bool = False) -> None:
    """Write `df`; columns are listed, sorted by name (the default) or as they are.

    The header is left out when appending. Numbers are written in their
    shortest form and NULL as nothing. `single_file` is for small results.
    """
    if not path:
        raise ValueError("write_csv: path is required")
    if column_order not in ("sorted", "as_is"):
        raise ValueError(f"write_csv: column_order must be 'sorted' or 'as_is', got {column_order!r}")
    wanted = require(df, names(columns), "write_csv")
    if not wanted:
        wanted = sorted(df.columns) if column_order == "sorted" else df.columns
    out = df.select(*[as_text(ref(c), dtype(df, c)).alias(c) for c in wanted])
    if single_file:
        out = out.coalesce(1)
    header = (not append) if header is None else header
    out.write.mode("append" if append else "overwrite").options(
        sep=delimiter if len(delimiter) == 1 else ",", header=str(header).lower(), quote='"', escape='"',
        emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)

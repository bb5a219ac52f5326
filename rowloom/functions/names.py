"""Column references and parameter lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def names(spec: str | Iterable[str] | None) -> list[str]:
    """`"a, b"` or `["a", "b"]` as a list of names."""
    if spec is None:
        return []
    parts = spec.split(",") if isinstance(spec, str) else list(spec)
    return [p.strip() for p in parts if p.strip()]


def require(df: DataFrame, columns: Iterable[str], where: str) -> list[str]:
    """Check that every column exists; returns them as a list."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: unknown column(s) {missing}; available: {df.columns}")
    return columns


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def fresh(taken: Iterable[str], stem: str) -> str:
    """A helper column name that does not clash with `taken`."""
    taken = set(taken)
    name, i = stem, 0
    while name in taken:
        i += 1
        name = f"{stem}{i}"
    return name

"""Text to number, integer and boolean, and values to text.

Spark's own casts are more tolerant than the grammar used here (they accept
surrounding blanks, `1d`, `yes`), so text is checked with a pattern first.
Typed columns are cast directly, which keeps filters on them pushable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import is_float, is_number, is_text

# The accepted spellings.
NUMBER_PATTERN = r"(?i)^([+-]?(inf(inity)?|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)|nan)\z"
INTEGER_PATTERN = r"^[+-]?\d+\z"
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")
BLANK_WORDS = ("", "null", "<nil>", "nan")


def parse_double(col: Column, kind: T.DataType) -> Column:
    """Double, or NULL where the value is not a number."""
    if is_number(kind):
        return col.cast("double")
    if is_text(kind):
        return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))
    return F.lit(None).cast("double")


def parse_long(col: Column, kind: T.DataType) -> Column:
    """64-bit integer, or NULL. Fractions are cut off for numeric columns."""
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return col.try_cast("bigint")
    if is_text(kind):
        return F.when(col.rlike(INTEGER_PATTERN), col.try_cast("bigint"))
    return F.lit(None).cast("bigint")


def parse_bool(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return col
    if is_number(kind):
        return col != F.lit(0)
    if is_text(kind):
        return F.when(col.isin(*TRUE_WORDS), F.lit(True)).when(col.isin(*FALSE_WORDS), F.lit(False))
    return F.lit(None).cast("boolean")


def number_or_zero(col: Column, kind: T.DataType, non_numeric: str = "zero") -> Column:
    """The double used by arithmetic aggregates; `non_numeric` is "zero" or "null"."""
    value = parse_double(col, kind)
    if non_numeric == "null":
        return value
    if non_numeric != "zero":
        raise ValueError(f"non_numeric must be 'zero' or 'null', got {non_numeric!r}")
    return F.coalesce(value, F.lit(0.0))


def is_blank(col: Column, kind: T.DataType) -> Column:
    """NULL, a word that stands for a missing value, or a floating NaN."""
    if is_text(kind):
        return F.coalesce(F.lower(col).isin(*BLANK_WORDS), F.lit(True))
    if is_float(kind):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def is_empty(col: Column, kind: T.DataType) -> Column:
    """NULL or the empty string."""
    if is_text(kind):
        return F.coalesce(col == "", F.lit(True))
    return col.isNull()


def number_text(col: Column) -> Column:
    """A double as its shortest plain text: 100, 1.5, 12345678.9, 1e+21."""
    raw = col.cast("string")
    size = F.abs(col)
    # Spark prints 1.2E7; a decimal of the printed digits gives the plain form.
    wide = raw.try_cast(T.DecimalType(38, 16)).cast("string")
    small = raw.try_cast(T.DecimalType(38, 24)).cast("string")
    plain = F.when(size < 1, small).otherwise(wide)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.abs(power).cast("string")
    scientific = F.concat(mantissa, sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(col), F.lit("NaN"))
        .when(col == float("inf"), F.lit("+Inf"))
        .when(col == float("-inf"), F.lit("-Inf"))
        .when(col == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def as_text(col: Column, kind: T.DataType) -> Column:
    if is_text(kind):
        return col
    if is_float(kind):
        return number_text(col if isinstance(kind, T.DoubleType) else col.cast("string").cast("double"))
    return col.cast("string")

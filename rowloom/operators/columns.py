"""Choosing, renaming, typing and computing columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import value_expr
from ..functions.names import dtype, is_text, names, ref, require
from ..functions.parsing import (
    BLANK_WORDS, FALSE_WORDS, INTEGER_PATTERN, NUMBER_PATTERN, TRUE_WORDS, as_text, parse_bool, parse_double, parse_long,
)

Step = Callable[[DataFrame], DataFrame]
TARGET_TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def select(columns) -> Step:
    """Keep the listed columns; one that does not exist becomes NULL."""
    wanted = names(columns)
    if not wanted:
        raise ValueError("select: no columns given")
    return lambda df: df.select(*[ref(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def rename_pairs(columns) -> dict[str, str]:
    """`"old:new, a:b"` or a mapping."""
    if isinstance(columns, Mapping):
        pairs = dict(columns)
    else:
        pairs = {}
        for part in names(columns):
            old, colon, new = part.partition(":")
            if not colon or not old.strip() or not new.strip():
                raise ValueError(f"rename: expected old:new, got {part!r}")
            pairs[old.strip()] = new.strip()
    if not pairs:
        raise ValueError("rename: no columns given")
    return pairs


def rename(columns, errors: str = "ignore") -> Step:
    """Rename columns; unknown ones are ignored or raise."""
    pairs = rename_pairs(columns)
    if errors not in ("ignore", "raise"):
        raise ValueError(f"rename: errors must be 'ignore' or 'raise', got {errors!r}")

    def step(df: DataFrame) -> DataFrame:
        if errors == "raise":
            require(df, pairs, "rename")
        after = [pairs.get(c, c) for c in df.columns]
        if len(set(after)) < len(after):
            raise ValueError(f"rename: two columns would share a name: {after}")
        return df.withColumnsRenamed(pairs)

    return step


def map_columns(mapping: Mapping[str, str]) -> Step:
    """Rename by a mapping, ignoring unknown names."""
    return rename(dict(mapping), errors="ignore")


def cast_value(df: DataFrame, column: str, target: str, errors: str) -> Column:
    col, kind = ref(column), dtype(df, column)
    if target == "string":
        return as_text(col, kind)
    parse = {"int": parse_long, "float": parse_double, "bool": parse_bool}[target]
    value = parse(col, kind)
    if errors == "null":
        return value
    message = F.concat(F.lit(f"cast: column {column!r} to {target}: "), col.cast("string"))
    failure = F.raise_error(message).cast(TARGET_TYPES[target])
    return F.when(col.isNotNull() & value.isNull(), failure).otherwise(value)


def cast(column: str, target_type: str, errors: str = "raise") -> Step:
    """Convert one column to string, int, float or bool."""
    return casts({column: target_type}, errors=errors, missing="raise")


def casts(rules: Mapping[str, str], errors: str = "raise", missing: str = "ignore") -> Step:
    """Convert several columns; unknown columns are ignored unless missing="raise"."""
    if errors not in ("raise", "null"):
        raise ValueError(f"cast: errors must be 'raise' or 'null', got {errors!r}")
    for column, target in rules.items():
        if not column or target not in TARGET_TYPES:
            raise ValueError(f"cast: unsupported type {target!r} for column {column!r}")

    def step(df: DataFrame) -> DataFrame:
        if missing == "raise":
            require(df, rules, "cast")
        return df.withColumns({c: cast_value(df, c, t, errors) for c, t in rules.items() if c in df.columns})

    return step


def add_column(name: str, expression: str, errors: str = "raise", sql: bool = False) -> Step:
    """Add or overwrite a column from a small expression, or from Spark SQL with sql=True."""
    if not name or not expression:
        raise ValueError("add_column: name and expression are required")
    return lambda df: df.withColumn(name, F.expr(expression) if sql else value_expr(expression, df, errors))


def auto_field(columns=None, mixed: str = "text") -> Step:
    """Give each text column the narrowest type all its values fit: int, float, bool, else text.

    One aggregation looks at all columns at once and returns a single row. Blank
    text decides nothing and is NULL in a column that gets a type. A column
    of several types stays text; with mixed="variant" it is a VARIANT column in which each value has its
    own type (bigint, double, boolean or string), read by `variant_get` and `schema_of_variant`.
    """
    if mixed not in ("text", "variant"):
        raise ValueError(f"auto_field: mixed must be 'text' or 'variant', got {mixed!r}")

    def step(df: DataFrame) -> DataFrame:
        wanted = require(df, names(columns) or df.columns, "auto_field")
        texts = [c for c in wanted if is_text(dtype(df, c))]
        if not texts:
            return df
        checks = []
        for i, c in enumerate(texts):
            col = ref(c)
            given = F.when(~F.coalesce(F.trim(col) == "", F.lit(True)), col)
            checks += [
                F.bool_and(given.rlike(INTEGER_PATTERN) & F.coalesce(given, F.lit("0")).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                F.bool_and(given.rlike(NUMBER_PATTERN)).alias(f"f{i}"),
                F.bool_and(given.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
            ]
        found = df.agg(*checks).first()
        typed = {}
        for i, c in enumerate(texts):
            for flag, target in (("i", "int"), ("f", "float"), ("b", "bool")):
                if found[f"{flag}{i}"]:
                    typed[c] = cast_value(df, c, target, "null")
                    break
            else:
                if mixed == "variant" and found[f"i{i}"] is not None:
                    typed[c] = _own_type(ref(c))
        return df.withColumns(typed) if typed else df

    return step


def _own_type(col: Column) -> Column:
    """A text as a VARIANT of the type it reads as; NaN and infinities, which are numbers too, are doubles."""
    def value(typed: Column) -> Column:
        return F.variant_get(F.to_variant_object(F.array(typed)), "$[0]", "variant")

    whole = F.when(col.rlike(INTEGER_PATTERN), col.try_cast("bigint"))
    number = F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))
    truth = F.when(col.isin(*TRUE_WORDS), F.lit(True)).when(col.isin(*FALSE_WORDS), F.lit(False))
    return F.when(whole.isNotNull(), value(whole)).when(number.isNotNull(), value(number)).when(truth.isNotNull(), value(truth)).when(
        col.isNotNull(), value(col))


def fillna(value, columns=None) -> Step:
    """Replace missing values (NULL, "", null, nan) by a constant of the column's type."""
    if value is None or value == "":
        raise ValueError("fillna: value must not be empty")

    def step(df: DataFrame) -> DataFrame:
        wanted = require(df, names(columns) or df.columns, "fillna")
        filled = {}
        for c in wanted:
            kind, col = dtype(df, c), ref(c)
            if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
                continue
            new = F.lit(str(value) if is_text(kind) else value)
            new = new if is_text(kind) else new.try_cast(kind)
            if is_text(kind):
                missing = F.coalesce(F.lower(col).isin(*BLANK_WORDS), F.lit(True))
                filled[c] = F.when(missing, new).otherwise(col)
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                filled[c] = F.coalesce(F.nanvl(col, F.lit(None).cast(kind)), new, col)
            else:
                filled[c] = F.coalesce(col, new)
        return df.withColumns(filled)

    return step

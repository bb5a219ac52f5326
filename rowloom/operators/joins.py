"""Equality joins with fixed output columns.

Catalyst and AQE choose the strategy, and AQE splits hot keys where the join
form allows it. Both keys are brought to one type first, which the output key
has for every join form. Where AQE cannot split (a hot key on the side that an
outer join does not preserve, or a full join) `split_hot` plans the join as an
inner join plus the rows without a partner; AQE can split each of these pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dtype, is_float, is_number, ref, require
from ..functions.parsing import as_text
from ..session import written
from .ordered import HOT_ROWS, row_index

JOIN_TYPES = ("inner", "left", "right", "full")
VALIDATIONS = ("", "one_to_one", "one_to_many", "many_to_one", "many_to_many")
LEFT_MATCH, RIGHT_MATCH = "__left_match", "__right_match"


def _wider(left: DataFrame, ka: T.DataType, kb: T.DataType) -> T.DataType:
    empty = left.sparkSession.range(0)
    return empty.select(F.coalesce(F.lit(None).cast(ka), F.lit(None).cast(kb)).alias("k")).schema["k"].dataType


def _one_type(left: DataFrame, lk: str, right: DataFrame, rk: str) -> tuple[Column, Column]:
    """Both keys in one type: their own, the wider number, or text."""
    ka, kb = dtype(left, lk), dtype(right, rk)
    if ka == kb:
        return ref(lk), ref(rk)
    if not (is_number(ka) and is_number(kb)):
        return as_text(ref(lk), ka), as_text(ref(rk), kb)
    wide = _wider(left, ka, kb)
    return ref(lk).cast(wide), ref(rk).cast(wide)


def _widened(key: Column, name: str, kind: T.DataType, wide: T.DataType) -> Column:
    """A key of the result in the wider type; a 64-bit integer that no float of that type equals fails the job instead of changing."""
    value = key.cast(wide)
    if not (isinstance(kind, T.LongType) and is_float(wide)):
        return value
    whole = T.DecimalType(38, 0)
    inexact = F.raise_error(F.concat(F.lit(f"join: key {name} = "), key.cast("string"), F.lit(f" is no {wide.simpleString()}; cast the keys first")))
    return F.when(key.isNull() | (value.cast(whole) == key.cast(whole)), value).otherwise(inexact.cast(wide))


def _matches(left: DataFrame, lk: str, right: DataFrame, rk: str) -> tuple[Column, Column] | None:
    """Columns that are equal where a 64-bit integer key equals a float exactly; None for other types."""
    ka, kb = dtype(left, lk), dtype(right, rk)
    if not (isinstance(ka, T.LongType) and is_float(kb) or is_float(ka) and isinstance(kb, T.LongType)):
        return None

    def parts(key: str, kind: T.DataType) -> Column:
        value = ref(key)
        if isinstance(kind, T.LongType):
            whole, rest = value, F.lit(None).cast("double")
        else:
            value = value.cast("double")
            is_whole = (F.floor(value) == value) & (value >= -(2.0 ** 63)) & (value < 2.0 ** 63)
            whole, rest = F.when(is_whole, value.try_cast("bigint")), F.when(~is_whole, value)
        return F.when(value.isNotNull(), F.struct(whole.alias("whole"), rest.alias("rest")))

    return parts(lk, ka), parts(rk, kb)


def _has_hot_key(side: DataFrame, key: str) -> bool:
    """Whether one key has more rows than a task should hold; one job that reads the key column only."""
    most = side.groupBy(ref(key)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return most > HOT_ROWS


def _joined(left: DataFrame, right: DataFrame, lk: str, rk: str, how: str, nulls_match: bool, left_names: dict[str, str],
            right_names: dict[str, str], split_hot: bool | str, stable: bool) -> DataFrame:
    outputs = [left_names[c] for c in left.columns] + [right_names[c] for c in right.columns if c != rk]
    if len(set(outputs)) < len(outputs):
        raise ValueError(f"join: two output columns would share a name: {outputs}")
    if split_hot not in (True, False, "auto"):
        raise ValueError(f"join: split_hot must be True, False or 'auto', got {split_hot!r}")
    if split_hot == "auto":
        sides = {"inner": (), "left": ((right, rk),), "right": ((left, lk),), "full": ((left, lk), (right, rk))}[how]
        split_hot = any(_has_hot_key(side, key) for side, key in sides)
    if split_hot and how != "inner" and not stable:
        left, right = written(left, "join-left"), written(right, "join-right")
    hidden = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    exact = _matches(left, lk, right, rk)
    left_match, right_match = exact or _one_type(left, lk, right, rk)
    mine = left.select("*", left_match.alias(LEFT_MATCH))
    other = right.select(*[ref(c).alias(hidden[c]) for c in right.columns], right_match.alias(RIGHT_MATCH))
    a, b = F.col(LEFT_MATCH), F.col(RIGHT_MATCH)
    if exact:  # keys are widened after the join: those that find no partner need not fit
        wide = _wider(left, dtype(left, lk), dtype(right, rk))
        a, b = _widened(ref(lk), lk, dtype(left, lk), wide), _widened(ref(hidden[rk]), rk, dtype(right, rk), wide)
    on = F.col(LEFT_MATCH).eqNullSafe(F.col(RIGHT_MATCH)) if nulls_match else F.col(LEFT_MATCH) == F.col(RIGHT_MATCH)
    rest = [c for c in right.columns if c != rk]

    def shown(df: DataFrame, key: Column) -> DataFrame:
        """The output columns; a side that `df` lacks is NULL."""
        def value(name: str, kind: T.DataType) -> Column:
            return ref(name) if name in df.columns else F.lit(None).cast(kind)

        columns = [(key if c == lk else value(c, left.schema[c].dataType)).alias(left_names[c]) for c in left.columns]
        return df.select(*columns, *[value(hidden[c], right.schema[c].dataType).alias(right_names[c]) for c in rest])

    if split_hot and how != "inner":
        result = shown(mine.join(other, on, "inner"), a)
        # Distinct keys first: a hot key becomes one row per task before the shuffle.
        if how in ("left", "full"):
            result = result.unionByName(shown(mine.join(other.select(RIGHT_MATCH).distinct(), on, "left_anti"), a))
        if how in ("right", "full"):
            result = result.unionByName(shown(other.join(mine.select(LEFT_MATCH).distinct(), on, "left_anti"), b))
        return result
    return shown(mine.join(other, on, how), F.coalesce(a, b) if how in ("right", "full") else a)


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner",
         nulls_match: bool = True, prefix: str = "right_", split_hot: bool | str = False, stable: bool = False) -> DataFrame:
    """Join on one key; the right key is dropped and clashing right columns get a prefix.

    Keys of two types are compared, and given out, as the wider number or as text. 64-bit integers and
    floats are equal only if they are the same number; an integer that has no float to be given out as fails the job.
    `split_hot` plans an outer join as an inner join plus the rows without a
    partner, so AQE may split a hot key on either side; "auto" does this if a
    count of the keys (one job) finds a hot one. The inputs are written first,
    unless they are `stable`: they give the same rows each time they are read.
    Neither option changes rows or types.
    """
    how = (how or "inner").lower()
    if how not in JOIN_TYPES:
        raise ValueError(f"join: type must be one of {JOIN_TYPES}, got {how!r}")
    if not left_key or not right_key:
        raise ValueError("join: left_key and right_key are required")
    require(left, [left_key], "join")
    require(right, [right_key], "join")
    right_names = {c: prefix + c if c in left.columns else c for c in right.columns}
    return _joined(left, right, left_key, right_key, how, nulls_match, {c: c for c in left.columns}, right_names, split_hot, stable)


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: str | None = None, left_on: str | None = None,
          right_on: str | None = None, left_suffix: str = "_x", right_suffix: str = "_y", validate: str | None = None,
          nulls_match: bool = True, split_hot: bool | str = False, stable: bool = False) -> DataFrame:
    """Join in the style of a data frame library: suffixes on both sides and a key check."""
    how = (how or "inner").lower()
    if how not in ("inner", "left", "right", "outer", "full"):
        raise ValueError(f"merge: how must be inner, left, right or outer, got {how!r}")
    lk, rk = left_on or on, right_on or on
    if not lk or not rk:
        raise ValueError("merge: give on, or left_on and right_on")
    require(left, [lk], "merge")
    require(right, [rk], "merge")
    check_cardinality(left, right, lk, rk, validate)
    rest = [c for c in right.columns if c != rk]
    clash = {c for c in rest if c in left.columns and c != lk}
    left_names = {c: c + left_suffix if c in clash else c for c in left.columns}
    right_names = {c: c + right_suffix if c in clash or c == lk else c for c in right.columns}
    return _joined(left, right, lk, rk, "full" if how == "outer" else how, nulls_match, left_names, right_names, split_hot, stable)


def check_cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str, validate: str | None) -> None:
    """Raise when a side declared `one` repeats a key. Runs one counting job per such side."""
    validate = validate or ""
    if validate not in VALIDATIONS:
        raise ValueError(f"merge: validate must be one of {VALIDATIONS[1:]}, got {validate!r}")
    for side, df, key, unique in (("left", left, left_key, validate.startswith("one_")),
                                  ("right", right, right_key, validate.endswith("_one"))):
        if not unique:
            continue
        counts = df.groupBy(ref(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        again = counts.filter("n > 1").limit(1).collect()
        if again:
            raise ValueError(f"merge: validate={validate}: {side} key {again[0]['k']!r} appears {again[0]['n']} times")


def append_fields(left: DataFrame, right: DataFrame, left_order_by, right_order_by, prefix: str = "right_",
                  unique_order: bool = False, stable: bool = False) -> DataFrame:
    """Put the rows of two inputs side by side, by position in the given orders.

    Every left row stays; right columns are NULL past the end of the right input.
    `unique_order` and `stable` are as for `row_index` and hold for both inputs.
    """
    at = "__zip"
    right_names = {c: prefix + c if c in left.columns else c for c in right.columns}
    outputs = left.columns + list(right_names.values())
    if len(set(outputs)) < len(outputs):
        raise ValueError(f"append_fields: two output columns would share a name: {outputs}")
    a = row_index(left_order_by, at, unique_order, stable)(left)
    b = row_index(right_order_by, at, unique_order, stable)(right)
    b = b.select(ref(at).alias("__zip_right"), *[ref(c).alias(right_names[c]) for c in right.columns])
    return a.join(b, F.col(at) == F.col("__zip_right"), "left").select(*[ref(c) for c in outputs])

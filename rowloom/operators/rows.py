"""Keeping, routing, ordering and combining rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import bool_expr, literal_number, number_predicate, split_conditions
from ..functions.names import dtype, fresh, is_text, names, ref, require
from ..functions.parsing import as_text, parse_bool, parse_double
from ..session import written
from .cleaning import trim_spaces
from .ordered import Numbered, by_ranges, directed, every_nth, order_keys, ranges_needed, row_index, tie_broken

Step = Callable[[DataFrame], DataFrame]
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "not_contains", "starts_with", "ends_with",
             "is_null", "is_not_null", "is_true", "is_false")
NUMBER_OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte")
LARGE_LIMIT = 1_000_000


def filter_rows(condition: str, errors: str = "raise") -> Step:
    """Keep rows for which `column OP literal` holds."""
    if not condition or not condition.strip():
        raise ValueError("filter: condition is required")
    return lambda df: df.filter(bool_expr(condition, df, errors))


def condition(df: DataFrame, field: str, operator: str, value="", value_type: str = "string",
              errors: str = "raise") -> Column:
    """One of 14 typed tests; NULL, which a filter takes as false, for missing values."""
    if operator not in OPERATORS:
        raise ValueError(f"filter_advanced: unknown operator {operator!r}")
    require(df, [field], "filter_advanced")
    col, kind = ref(field), dtype(df, field)
    if operator == "is_null":
        return col.isNull()
    if operator == "is_not_null":
        return col.isNotNull()
    if value_type == "number":
        bound = literal_number(str(value).strip())
        if operator not in NUMBER_OPERATORS or bound is None:
            raise ValueError(f"filter_advanced: {operator} {value!r} does not apply to numbers")
        if not is_text(kind):
            cond = number_predicate(df, field, operator, bound, errors)
        else:
            text = trim_spaces(col)
            number = parse_double(text, T.StringType())
            if errors == "raise":
                bad = F.raise_error(F.concat(F.lit(f"field {field!r} is not a number: "), col)).cast("double")
                number = F.when(col.isNotNull() & number.isNull(), bad).otherwise(number)
            tests = {"eq": number == bound, "neq": number != bound, "lt": number < bound, "lte": number <= bound,
                     "gt": (number > bound) & ~F.isnan(number), "gte": (number >= bound) & ~F.isnan(number)}
            cond = tests[operator]
    elif value_type == "bool":
        if operator not in ("is_true", "eq", "is_false", "neq"):
            raise ValueError(f"filter_advanced: {operator} does not apply to booleans")
        truth = parse_bool(trim_spaces(col) if is_text(kind) else col, kind)
        if errors == "raise" and is_text(kind):
            bad = F.raise_error(F.concat(F.lit(f"field {field!r} is not a boolean: "), col)).cast("boolean")
            truth = F.when(col.isNotNull() & truth.isNull(), bad).otherwise(truth)
        cond = truth if operator in ("is_true", "eq") else ~truth
    elif value_type == "string":
        text, wanted = as_text(col, kind), F.lit(str(value))
        tests = {"eq": text == wanted, "neq": text != wanted, "gt": text > wanted, "lt": text < wanted,
                 "contains": F.contains(text, wanted), "not_contains": ~F.contains(text, wanted),
                 "starts_with": F.startswith(text, wanted), "ends_with": F.endswith(text, wanted)}
        if operator not in tests:
            raise ValueError(f"filter_advanced: {operator} does not apply to text")
        cond = tests[operator]
    else:
        raise ValueError(f"filter_advanced: value_type must be string, number or bool, got {value_type!r}")
    return cond


def filter_advanced(df: DataFrame, field: str, operator: str, value="", value_type: str = "string",
                    errors: str = "raise") -> tuple[DataFrame, DataFrame]:
    """The rows that pass a typed test, and all other rows."""
    cond = condition(df, field, operator, value, value_type, errors)
    return df.filter(cond), df.filter(~F.coalesce(cond, F.lit(False)))


def match_advanced(tests: Iterable[tuple], name: str = "_match", errors: str = "raise") -> Step:
    """An array column with, for each (field, operator, value, value_type), whether the row passes: all tests in one pass."""
    tests = list(tests)

    def step(df: DataFrame) -> DataFrame:
        return df.withColumn(name, F.array(*[F.coalesce(condition(df, *t, errors=errors), F.lit(False)) for t in tests]))

    return step


def filter_rules(rules: Iterable[tuple[str, str, object]], compare_as: str = "string") -> Step:
    """All of (column, eq|neq|gt|lt, value) must hold; compared as text unless compare_as="number"."""
    rules = list(rules)
    for _, operator, _ in rules:
        if operator not in ("eq", "neq", "gt", "lt"):
            raise ValueError(f"filter_rules: unknown operator {operator!r}")

    def step(df: DataFrame) -> DataFrame:
        kept = F.lit(True)
        for column, operator, value in rules:
            if column not in df.columns:
                return df.filter(F.lit(False))
            if compare_as == "number":
                kept = kept & number_predicate(df, column, operator, float(value), "null")
                continue
            text, wanted = as_text(ref(column), dtype(df, column)), F.lit(str(value))
            kept = kept & {"eq": text == wanted, "neq": ~text.eqNullSafe(wanted), "gt": text > wanted,
                           "lt": text < wanted}[operator]
        return df.filter(kept)

    return step


def route(conditions, name: str = "_route", errors: str = "raise") -> Step:
    """Number each row by its first true condition; rows without one get the last number."""
    tests = [c.strip() for c in (split_conditions(conditions) if isinstance(conditions, str) else conditions)]
    if not tests or not all(tests):
        raise ValueError("split: conditions are required")

    def step(df: DataFrame) -> DataFrame:
        branch = F
        for i, test in enumerate(tests):
            branch = branch.when(bool_expr(test, df, errors), F.lit(i))
        return df.withColumn(name, branch.otherwise(F.lit(len(tests))))

    return step


def split(df: DataFrame, conditions, outputs: int | None = None, errors: str = "raise") -> list[DataFrame]:
    """One DataFrame per condition and a last one for the remaining rows."""
    tests = split_conditions(conditions) if isinstance(conditions, str) else list(conditions)
    if outputs is not None and outputs != len(tests) + 1:
        raise ValueError(f"split: {len(tests)} conditions need {len(tests) + 1} outputs, got {outputs}")
    name = fresh(df.columns, "_route")
    routed = route(tests, name, errors)(df)
    return [routed.filter(ref(name) == i).drop(name) for i in range(len(tests) + 1)]


def dummy(df: DataFrame) -> DataFrame:
    """Pass the rows on unchanged."""
    return df


def chain(*steps: Step) -> Step:
    """Several one-input steps as one."""
    return lambda df: reduce(DataFrame.transform, steps, df)


def fork(df: DataFrame, n: int, persist: bool = False) -> list[DataFrame]:
    """The same rows n times; persist=True keeps a costly parent for all of them."""
    if n < 1:
        raise ValueError("fork: n must be at least 1")
    shared = df.persist() if persist else df
    return [shared] * n


def dedup(keys=None, order_by=None, unique_order: bool = False) -> Step:
    """One row per key: the first in `order_by`, or any one without an order."""
    return drop_duplicates(keys, "first", order_by, unique_order=unique_order)


def drop_duplicates(subset=None, keep: str | bool = "first", order_by=None, ignore_index: bool = False,
                    unique_order: bool = False, index_by=None) -> Step:
    """Keep the first, the last or (keep=False) only never-repeated rows per key.

    `ignore_index` adds `_index`, numbered by `index_by` or else `order_by`.
    """
    keep = "none" if keep in (False, "false", "none") else keep
    if keep not in ("first", "last", "none"):
        raise ValueError(f"drop_duplicates: keep must be first, last or False, got {keep!r}")
    if ignore_index and not (index_by or order_by):
        raise ValueError("drop_duplicates: ignore_index needs order_by")

    def step(df: DataFrame) -> DataFrame:
        keys = require(df, names(subset), "drop_duplicates")
        if keep == "none":
            result = _never_repeated(df, keys or df.columns)
        elif not keys or set(keys) == set(df.columns):
            result = df.dropDuplicates()
        elif order_by is None:
            if keep == "last":
                raise ValueError("drop_duplicates: keep='last' needs order_by")
            result = df.dropDuplicates(keys)
        else:
            result = _end_row(df, keys, order_keys(order_by, df), keep == "first", unique_order)
        return row_index(index_by or order_by, "_index", unique_order)(result) if ignore_index else result

    return step


def _end_row(df, keys, order, first, unique_order) -> DataFrame:
    # A rank filter below 2 is planned with a limit per task before the shuffle,
    # so a hot key sends one row per task.
    prepared, ties = tie_broken(df, unique_order, split_copies=False)
    by = [directed(n, up if first else not up) for n, up in order]
    by += [ref(t).asc() if first else ref(t).desc() for t in ties]
    at = fresh(prepared.columns, "__rank")
    ranked = prepared.withColumn(at, F.row_number().over(Window.partitionBy(*[ref(k) for k in keys]).orderBy(*by)))
    return ranked.filter(ref(at) == 1).select(*[ref(c) for c in df.columns])


def _never_repeated(df, keys) -> DataFrame:
    # Counting with map-side combining instead of a window: no task holds a group.
    rest = [c for c in df.columns if c not in keys]
    aggregates = [F.count(F.lit(1)).alias("__n")]
    if rest:
        aggregates.append(F.any_value(F.struct(*[ref(c) for c in rest])).alias("__rest"))
    once = df.groupBy(*[ref(k) for k in keys]).agg(*aggregates).filter(F.col("__n") == 1)
    rest_set = set(rest)
    return once.select(*[F.col("__rest").getField(c).alias(c) if c in rest_set else ref(c) for c in df.columns])


def sort_keys(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Typed columns in their own order; text with numbers before other text. NULL is least."""
    keys: list[Column] = []
    for name, up in order:
        kind = dtype(df, name)
        parts = [ref(name)]
        if is_text(kind):
            number = parse_double(ref(name), kind)
            parts = [F.when(ref(name).isNull(), 0).when(number.isNotNull(), 1).otherwise(2), number, ref(name)]
        keys += [p.asc_nulls_first() if up else p.desc_nulls_last() for p in parts]
    return keys


def sort(columns, order: str = "asc", limit: int | None = None, unique_order: bool = False) -> Step:
    """Order all rows; `order` is the default direction, "name desc" sets one column's.

    Ties are broken by content, so the order is the same for any partitioning
    and a hot key is spread over several ranges. The rows are counted first, and
    where the shuffle partitions would be too large there are more ranges. A limit
    over LARGE_LIMIT rows is taken from sorted ranges, not by one task.
    """
    if order not in ("asc", "desc"):
        raise ValueError(f"sort: order must be asc or desc, got {order!r}")
    if not names(columns) if isinstance(columns, str) else not columns:
        raise ValueError("sort: columns are required")

    def step(df: DataFrame) -> DataFrame:
        given = columns.split(",") if isinstance(columns, str) else list(columns)
        items = []
        for item in given:
            text = item.strip() if isinstance(item, str) else item
            plain = isinstance(text, str) and (text in df.columns or not text.lower().endswith((" asc", " desc")))
            items.append((text, order) if plain else text)
        keys = order_keys(items, df)
        small = limit is not None and limit <= LARGE_LIMIT
        prepared, ties = tie_broken(df, unique_order, split_copies=not small)
        by = sort_keys(prepared, keys) + [ref(t).asc() for t in ties]
        if small:
            return prepared.orderBy(*by).limit(limit).drop(*ties)
        ranges = ranges_needed(df, df.count())
        if limit is None and ranges is None:
            return prepared.orderBy(*by).drop(*ties)
        ordered = by_ranges(prepared, by, ranges).drop(*ties)
        return ordered if limit is None else _first_of_ranges(ordered, limit)

    return step


def _first_of_ranges(ordered: DataFrame, n: int) -> DataFrame:
    """The first `n` rows of sorted ranges, in order; each range is cut by itself, so no task gets them all."""
    seq = fresh(ordered.columns, "__seq")
    table = Numbered(written(ordered.withColumn(seq, F.monotonically_increasing_id()), "sorted"), seq)
    at = fresh(table.df.columns, "__at")
    first = table.df.withColumn(at, table.position()).where(ref(at) < n)
    return by_ranges(first, [ref(at)], ranges_needed(ordered, n)).drop(seq, at)


def sampling(mode: str = "first", value: float = 0, order_by=None, seed: int | None = None, key=None,
             unique_order: bool = False, stable: bool = False) -> Step:
    """first: the first `value` rows; percent: each row with that chance; every: each value-th row.

    percent with `key` draws by the first 60 bits of the MD5 of `seed` and the
    key columns as text: the same rows each time and on any engine, and all rows
    of a key together. `first` gives its rows in no defined order. `stable` is as for `row_index`.
    """
    if value <= 0:
        raise ValueError("sampling: value must be greater than 0")
    if mode not in ("first", "percent", "every"):
        raise ValueError(f"sampling: mode must be first, percent or every, got {mode!r}")

    def step(df: DataFrame) -> DataFrame:
        if mode == "percent":
            share = min(value / 100.0, 1.0)
            if key is None:
                return df.sample(fraction=share, seed=seed)
            if share >= 1:
                return df
            parts = [F.coalesce(as_text(ref(k), dtype(df, k)), F.lit("\x00")) for k in require(df, names(key), "sampling")]
            drawn = F.conv(F.left(F.md5(F.concat_ws("\x1f", F.lit(str(seed or 0)), *parts)), F.lit(15)), 16, 10).cast("bigint")
            return df.filter(drawn < int(share * 2**60))
        if mode == "every":
            return every_nth(max(int(value), 1), order_by or (), unique_order, stable)(df)
        n = int(value)
        if order_by is None:
            return df.limit(n)
        if n > LARGE_LIMIT:  # too many rows for the one task that ends a top-n
            at = fresh(df.columns, "__at")
            return row_index(order_by, at, unique_order, stable)(df).filter(ref(at) < n).drop(at)
        keys = order_keys(order_by, df)
        prepared, ties = tie_broken(df, unique_order, split_copies=False)
        by = [directed(c, up) for c, up in keys] + [ref(t).asc() for t in ties]
        return prepared.orderBy(*by).limit(n).drop(*ties)

    return step


def union(*inputs: DataFrame) -> DataFrame:
    """All rows of two or more inputs; columns an input lacks are NULL.

    A column that is text in one input and not in another becomes text.
    """
    if len(inputs) < 2:
        raise ValueError("union: at least two inputs are required")
    kinds: dict[str, list[T.DataType]] = {}
    for df in inputs:
        for field in df.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)

    def unify(df: DataFrame) -> DataFrame:
        columns = []
        for c in df.columns:
            kind, others = dtype(df, c), kinds[c]
            mixed = any(is_text(o) for o in others) and not all(is_text(o) for o in others)
            columns.append(as_text(ref(c), kind).alias(c) if mixed else ref(c))
        return df.select(*columns)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [unify(df) for df in inputs])

"""Grouping, pivoting and unpivoting.

All aggregates combine on the map side, so a hot group sends one row per task.
So are the counts behind the exact median of a large group; see `_ranged_medians`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import dtype, is_text, names, ref, require
from ..functions.parsing import as_text, is_empty, number_or_zero
from ..session import written
from .ordered import order_keys, row_hash

Step = Callable[[DataFrame], DataFrame]
BASIC = ("SUM", "COUNT", "AVG", "MIN", "MAX")
FUNCTIONS = BASIC + ("FIRST", "LAST", "MEDIAN", "NUNIQUE", "STD", "VAR")
#: Bins in which a pass counts the values of a group.
MEDIAN_BINS = 1024
#: Values that are sorted at the end, where a caller does not allow for more.
MEDIAN_FEW = 10_000
_ITEM = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*(?:\s[Aa][Ss]\s+(.+?)\s*)?$", re.S)


class Aggregation(NamedTuple):
    function: str
    column: str
    alias: str


def parse_aggregations(spec, allowed: Iterable[str], where: str, skip_malformed: bool = False) -> list[Aggregation]:
    """`"SUM(x) AS total, COUNT(y)"` or a list of such items."""
    found = []
    for item in names(spec):
        m = _ITEM.match(item)
        if not m:
            if skip_malformed:
                continue
            raise ValueError(f"{where}: invalid aggregation {item!r}")
        function, column = m.group(1).upper(), m.group(2).strip()
        if function not in allowed:
            raise ValueError(f"{where}: unsupported function {function!r}")
        found.append(Aggregation(function, column, m.group(3) or f"{function}_{column}"))
    if not found:
        raise ValueError(f"{where}: no aggregation given")
    return found


def _numeric(df: DataFrame, item: Aggregation, non_numeric: str) -> Column:
    return number_or_zero(ref(item.column), dtype(df, item.column), non_numeric)


def _basic(df: DataFrame, item: Aggregation, non_numeric: str) -> Column:
    value = _numeric(df, item, non_numeric)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[item.function](value)


def _text_order(df: DataFrame, keys: list[str]) -> list[Column]:
    return [as_text(ref(k), dtype(df, k)).asc_nulls_first() for k in keys]


def aggregate(group_by, aggregations, non_numeric: str = "zero", sort: bool = True) -> Step:
    """SUM, COUNT, AVG, MIN and MAX per group as FUNC_column; COUNT counts rows."""
    keys = names(group_by)
    if not keys:
        raise ValueError("aggregate: group_by is required")
    items = parse_aggregations(aggregations, BASIC, "aggregate", skip_malformed=True)

    def step(df: DataFrame) -> DataFrame:
        require(df, keys + [i.column for i in items if i.function != "COUNT"], "aggregate")
        columns = [
            (F.count(F.lit(1)) if i.function == "COUNT" else _basic(df, i, non_numeric)).alias(i.alias) for i in items
        ]
        out = df.groupBy(*[ref(k) for k in keys]).agg(*columns)
        return out.orderBy(*_text_order(out, keys)) if sort else out

    return step


def groupby(by, aggregations, sort: bool = True, as_index: bool = True, dropna: bool = True,
            non_numeric: str = "zero", order_by=None, unique_order: bool = False,
            median_values: int = 1_000_000) -> Step:
    """Per-group SUM COUNT AVG MIN MAX FIRST LAST MEDIAN NUNIQUE STD VAR.

    COUNT leaves out NULL and ""; NUNIQUE counts NULL as one value; STD and VAR
    are 0 for a single row; FIRST and LAST need `order_by`, and `unique_order`
    says that it is a key (no ties, no NULL). `as_index=False`
    drops the key columns and `dropna` drops rows with an empty key.
    """
    keys = names(by)
    if not keys:
        raise ValueError("groupby: by is required")
    items = parse_aggregations(aggregations, FUNCTIONS, "groupby")
    if order_by is None and any(i.function in ("FIRST", "LAST") for i in items):
        raise ValueError("groupby: FIRST and LAST need order_by")

    def step(df: DataFrame) -> DataFrame:
        require(df, keys + [i.column for i in items], "groupby")
        if dropna:
            df = df.filter(~reduce(lambda a, b: a | b, [is_empty(ref(k), dtype(df, k)) for k in keys]))
        position = None
        if order_by is not None:
            order = order_keys(order_by, df)
            if len({up for _, up in order}) > 1:
                raise ValueError("groupby: order_by must have one direction for FIRST and LAST")
            ties = [] if unique_order else [row_hash(df)]
            # A key on its own keeps fixed-size buffers, so numbers stay in hash aggregation.
            alone = unique_order and len(order) == 1
            position = ref(order[0][0]) if alone else F.struct(*[ref(n) for n, _ in order], *ties)
            ascending = order[0][1]
        medians = [i for i in items if i.function == "MEDIAN"]
        ranged, all_large = None, False
        if medians:
            sizes = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
            large = sizes.agg(F.count_if(F.col("n") > median_values).alias("large"), F.count("n").alias("all")).first()
            if large["large"]:
                ranged = written(_spans(df, keys, medians, non_numeric).where(F.col("__rows") > median_values), "median-groups")
                all_large = large["large"] == large["all"]
        columns = []
        for item in items:
            col, kind = ref(item.column), dtype(df, item.column)
            if item.function == "COUNT":
                value = F.count(F.when(~is_empty(col, kind), F.lit(1)))
            elif item.function == "NUNIQUE":
                value = F.count_distinct(col) + F.max(F.when(col.isNull(), 1).otherwise(0)).cast("bigint")
            elif item.function in ("FIRST", "LAST"):
                pick = F.min_by if (item.function == "FIRST") == ascending else F.max_by
                value = pick(col, position)
            elif item.function == "MEDIAN":
                if ranged:
                    continue
                value = F.median(_numeric(df, item, non_numeric))
            elif item.function in ("STD", "VAR"):
                spread = F.stddev_samp if item.function == "STD" else F.var_samp
                value = F.coalesce(spread(_numeric(df, item, non_numeric)), F.lit(0.0))
            else:
                value = _basic(df, item, non_numeric)
            columns.append(value.alias(item.alias))
        if columns:
            out = df.groupBy(*[ref(k) for k in keys]).agg(*columns)
        else:
            out = df.select(*[ref(k) for k in keys]).distinct()
        if ranged:
            out = _with_medians(out, df, keys, medians, non_numeric, ranged, median_values, all_large)
        if sort:
            out = out.orderBy(*_text_order(out, keys))
        return out.select(*([ref(k) for k in keys] if as_index else []), *[ref(i.alias) for i in items])

    return step


def _spans(df: DataFrame, keys: list[str], medians: list[Aggregation], non_numeric: str) -> DataFrame:
    """Per group: its rows and, per median, the count, the least and the greatest value; all combined on the map side."""
    values = [_numeric(df, m, non_numeric) + F.lit(0.0) for m in medians]  # -0.0 becomes 0.0
    spans = [F.struct(F.lit(i).alias("item"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")) for i, v in enumerate(values)]
    grouped = df.groupBy(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return grouped.agg(F.count(F.lit(1)).alias("__rows"), F.array(*spans).alias("__spans"))


def _log_scale(v: Column) -> Column:
    """A number that grows with the logarithm of a value's size on either side of zero; Java's logarithm never decreases."""
    size = F.when(v == 0, 0.0).when(F.abs(v) == float("inf"), 1500.0).otherwise(F.log(F.abs(v)) + 746.0)
    return F.when(F.isnan(v), 1600.0).when(v < 0, -size).otherwise(size)


def _ranged_medians(df: DataFrame, keys: list[str], medians: list[Aggregation], non_numeric: str, spans: DataFrame, limit: int) -> DataFrame:
    """The exact medians of the groups in `spans`, which have any size: (__k0.., one column per median).

    Each pass counts the values of every group in MEDIAN_BINS bins of the span
    that holds the wanted rank, for all medians at once, and goes on with that
    bin's own span. Bins are even in turn by value and by its logarithm, so a few
    passes leave few values whatever the distribution. Nothing is sorted or
    shuffled but the counts, and those last values.
    """
    group = [f"__k{i}" for i in range(len(keys))]
    same = lambda a, b: reduce(and_, [a[g].eqNullSafe(b[g]) for g in group] + [a["item"] == b["item"]])
    values = F.array(*[F.struct(F.lit(i).alias("item"), (_numeric(df, m, non_numeric) + F.lit(0.0)).alias("v")) for i, m in enumerate(medians)])
    long = df.select(*[ref(k).alias(g) for g, k in zip(group, keys, strict=True)], F.inline(values)).where("v IS NOT NULL")
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    wanted = spans.select(*group, F.inline("__spans")).where("n > 0").select(*group, "item", "n", "lo", "hi", F.explode(ranks).alias("rank"))
    wanted = wanted.withColumns({"before": F.lit(0).cast("long"), "many": F.col("n")}).drop("n")
    by_log, limit = False, max(limit, MEDIAN_FEW)
    while not wanted.where((F.col("lo") != F.col("hi")) & (F.col("many") > limit)).isEmpty():
        wanted = written(_narrowed(long, wanted, group, same, limit, by_log), "median-spans")
        by_log = not by_log
    found = _inside(long, wanted.where("lo != hi"), group, same).groupBy(*group, "item", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    w, s = wanted.alias("w"), found.alias("s")
    on = same(_Names("w"), _Names("s")) & (F.col("w.lo") == F.col("s.lo")) & (F.col("w.hi") == F.col("s.hi"))
    exact = F.when(F.col("w.lo") == F.col("w.hi"), F.col("w.lo")).otherwise(F.get("s.sorted", (F.col("rank") - F.col("before") - 1).cast("int")))
    each = w.join(s, on, "left").select(*[F.col(f"w.{g}").alias(g) for g in group], F.col("w.item").alias("item"), exact.alias("v"))
    mids = [F.avg(F.when(F.col("item") == i, F.col("v"))).alias(f"__median{i}") for i in range(len(medians))]
    return each.groupBy(*group).agg(*mids)


class _Names:
    """Columns of an aliased table."""

    def __init__(self, alias: str) -> None:
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def _inside(long: DataFrame, spans: DataFrame, group: list[str], same) -> DataFrame:
    """(group.., item, lo, hi, v) of the values in each different span."""
    distinct = spans.select(*group, "item", "lo", "hi").distinct()
    rows = long.alias("a").join(distinct.alias("b"), same(_Names("a"), _Names("b")) & F.col("v").between(F.col("b.lo"), F.col("b.hi")))
    return rows.select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.item").alias("item"), "lo", "hi", "v")


def _narrowed(long: DataFrame, wanted: DataFrame, group: list[str], same, limit: int, by_log: bool) -> DataFrame:
    """The spans of the bins that hold the ranks; spans that are narrow enough stay."""
    wide = wanted.where((F.col("lo") != F.col("hi")) & (F.col("many") > limit))
    scale = lambda c: F.when(F.lit(by_log) | (F.abs(F.col("hi") - F.col("lo")) == float("inf")) | F.isnan(F.col("hi") - F.col("lo")), _log_scale(c)).otherwise(c)
    part = F.try_divide(scale(F.col("v")) - scale(F.col("lo")), scale(F.col("hi")) - scale(F.col("lo")))
    bin_ = F.coalesce(F.least(F.floor(part * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1)), F.lit(0))
    bins = _inside(long, wide, group, same).withColumn("bin", bin_)
    counts = bins.groupBy(*group, "item", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("here"), F.min("v").alias("low"), F.max("v").alias("high"))
    so_far = Window.partitionBy(*group, "item", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("less", F.coalesce(F.sum("here").over(so_far), F.lit(0)))
    w, c = wide.alias("w"), counts.alias("c")
    place = F.col("w.rank") - F.col("w.before")
    on = same(_Names("w"), _Names("c")) & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi")) & (F.col("less") < place) & (place <= F.col("less") + F.col("here"))
    next_ = w.join(c, on).select(*[F.col(f"w.{g}").alias(g) for g in group], F.col("w.item").alias("item"), F.col("low").alias("lo"), F.col("high").alias("hi"),
                                 "rank", (F.col("before") + F.col("less")).alias("before"), F.col("here").alias("many"))
    return next_.unionByName(wanted.where((F.col("lo") == F.col("hi")) | (F.col("many") <= limit)))


def _with_medians(out: DataFrame, df: DataFrame, keys: list[str], medians: list[Aggregation], non_numeric: str, large: DataFrame, limit: int,
                  all_large: bool) -> DataFrame:
    """`out` with its medians: of the groups in `large` from counts, of the others, if there are any, by Spark's own."""
    group = [f"__k{i}" for i in range(len(keys))]
    is_large = reduce(and_, [ref(k).eqNullSafe(F.col(g)) for g, k in zip(group, keys, strict=True)])
    if all_large:
        found = _ranged_medians(df, keys, medians, non_numeric, large, limit)
    else:
        rest = df.join(large.select(*group), is_large, "left_anti").groupBy(*[ref(k).alias(g) for g, k in zip(group, keys, strict=True)]).agg(
            *[F.median(_numeric(df, m, non_numeric)).alias(f"__median{i}") for i, m in enumerate(medians)])
        rows = df.join(large.select(*group), is_large, "left_semi")
        found = rest.unionByName(_ranged_medians(rows, keys, medians, non_numeric, large, limit))
    out = out.join(found, is_large, "left")
    return out.withColumns({m.alias: F.col(f"__median{i}") for i, m in enumerate(medians)}).drop(*group, *[f"__median{i}" for i in range(len(medians))])


def pivot(group_by: str, pivot_column: str, value_column: str, aggregation: str = "SUM", values=None,
          non_numeric: str = "zero") -> Step:
    """One row per group and one column per pivot value; a missing cell is 0.

    `values` saves the job that finds the distinct pivot values.
    """
    if not group_by or not pivot_column or not value_column:
        raise ValueError("pivot: group_by, pivot_column and value_column are required")
    function = (aggregation or "SUM").upper()
    if function not in BASIC:
        raise ValueError(f"pivot: unsupported function {function!r}")

    def step(df: DataFrame) -> DataFrame:
        keys = require(df, names(group_by), "pivot")
        require(df, [pivot_column, value_column], "pivot")
        label = F.coalesce(as_text(ref(pivot_column), dtype(df, pivot_column)), F.lit("null")).alias("__p")
        cell = number_or_zero(ref(value_column), dtype(df, value_column), non_numeric).alias("__v")
        narrow = df.select(*[ref(k) for k in keys], label, cell)
        wanted = [str(v) for v in values] if values is not None else _labels(narrow)
        total = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}.get(function)
        value = total("__v") if total else F.count(F.lit(1))
        out = narrow.groupBy(*[ref(k) for k in keys]).pivot("__p", wanted).agg(value)
        zero = F.lit(0.0) if total else F.lit(0).cast("bigint")
        return out.withColumns({w: F.coalesce(ref(w), zero) for w in wanted})

    return step


def _labels(narrow: DataFrame) -> list[str]:
    # One output column per label: bounded by the width a result may have.
    most = int(narrow.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in narrow.select("__p").distinct().orderBy("__p").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"pivot: more than {most} pivot values; filter them or raise spark.sql.pivotMaxValues")
    return found


def unpivot(columns, key_name: str = "key", value_name: str = "value") -> Step:
    """One row per listed column and input row; the other columns are repeated."""
    wanted = names(columns)
    if not wanted:
        raise ValueError("unpivot: columns are required")

    def step(df: DataFrame) -> DataFrame:
        require(df, wanted, "unpivot")
        kept = [c for c in df.columns if c not in wanted]
        if len(set(kept + [key_name, value_name])) < len(kept) + 2:
            raise ValueError("unpivot: key_name and value_name must be new, different names")
        kinds = {dtype(df, c).simpleString() for c in wanted}
        if any(is_text(dtype(df, c)) for c in wanted) and len(kinds) > 1:
            df = df.withColumns({c: as_text(ref(c), dtype(df, c)) for c in wanted})
        return df.unpivot([ref(c) for c in kept], [ref(c) for c in wanted], key_name, value_name)

    return step

"""Group statistics that can be stored and merged: numbers of different values and quantiles, with a stated error.

A table of sketches has one row per group and one small binary column per statistic. Tables of different days or
parts are put together by `merge_sketches` without the rows, with the same result as one sketch over all rows has
within its error. Distinct counts have a relative standard error of 1.04 / 2**(lg_k / 2), 1.6 % with 12; a quantile
is right to about 2.3 / k of the ranks, 0.6 % with 400. All combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import dtype, names, ref, require
from ..functions.parsing import number_or_zero
from .groups import Aggregation, parse_aggregations

Step = Callable[[DataFrame], DataFrame]
FUNCTIONS = ("NUNIQUE", "MEDIAN")
LG_K, QUANTILE_K = 12, 400


def distinct_sketch(column: Column, lg_k: int = LG_K) -> Column:
    """Of the values of any type, NULL being one."""
    return F.hll_sketch_agg(F.xxhash64(column), lg_k)


def quantile_sketch(column: Column, k: int = QUANTILE_K) -> Column:
    """Of the numbers of a double column, without NULL and NaN."""
    return F.kll_sketch_agg_double(column, k)


def distinct_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(sketch: Column, share: float = 0.5) -> Column:
    """The value at a share of the ranks, NULL without any number."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def _items(spec, where: str) -> list[Aggregation]:
    return parse_aggregations(spec, FUNCTIONS, where)


def sketch_groups(by, sketches, lg_k: int = LG_K, k: int = QUANTILE_K, non_numeric: str = "zero") -> Step:
    """One row of sketches per group: `"NUNIQUE(x) AS users, MEDIAN(y) AS mid"`."""
    keys, items = names(by), _items(sketches, "sketch_groups")

    def step(df: DataFrame) -> DataFrame:
        require(df, keys + [i.column for i in items], "sketch_groups")
        columns = [distinct_sketch(ref(i.column), lg_k) if i.function == "NUNIQUE" else
                   quantile_sketch(number_or_zero(ref(i.column), dtype(df, i.column), non_numeric), k) for i in items]
        return df.groupBy(*[ref(c) for c in keys]).agg(*[c.alias(i.alias) for c, i in zip(columns, items, strict=True)])

    return step


def merge_sketches(by, sketches) -> Step:
    """One row of sketches per group of `by`, from rows of sketches with at least these keys."""
    keys, items = names(by), _items(sketches, "merge_sketches")

    def step(df: DataFrame) -> DataFrame:
        require(df, keys + [i.alias for i in items], "merge_sketches")
        columns = [(F.hll_union_agg if i.function == "NUNIQUE" else F.kll_merge_agg_double)(ref(i.alias)).alias(i.alias) for i in items]
        return df.groupBy(*[ref(c) for c in keys]).agg(*columns)

    return step


def estimate_sketches(sketches, share: float = 0.5) -> Step:
    """The numbers that rows of sketches stand for; `share` is the quantile's (the median's is a half)."""
    items = _items(sketches, "estimate_sketches")
    if not 0 <= share <= 1:
        raise ValueError(f"estimate_sketches: share must be between 0 and 1, got {share}")

    def step(df: DataFrame) -> DataFrame:
        require(df, [i.alias for i in items], "estimate_sketches")
        return df.withColumns({i.alias: distinct_estimate(ref(i.alias)) if i.function == "NUNIQUE" else quantile_estimate(ref(i.alias), share) for i in items})

    return step

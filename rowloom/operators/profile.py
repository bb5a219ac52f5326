"""Looking at the data: per-column summary, value frequencies, correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dtype, is_number, names, ref, require
from ..functions.parsing import parse_double
from ..session import written

Step = Callable[[DataFrame], DataFrame]
#: Pairs up to which each is an aggregate of its own; beyond, matrix products of blocks of rows give all pairs.
PAIRS_PER_PASS = 100
#: Numbers of a block of rows.
BLOCK_CELLS = 1 << 20
#: A first value is a poor origin where the mean is so many standard deviations away; then the sums are taken once more from the means.
FAR = 1e4
#: Spread that is only rounding, as a share of the squares around the origin.
ROUNDING = 1e-13
MOMENTS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def field_summary(columns=None) -> Step:
    """One row per column: count, nulls and, where there are numbers, min, max and mean. One pass."""

    def step(df: DataFrame) -> DataFrame:
        wanted = require(df, names(columns) or df.columns, "field_summary")
        aggregates = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(wanted):
            number = parse_double(ref(c), dtype(df, c))
            aggregates += [F.count_if(ref(c).isNull()).alias(f"nulls{i}"), F.min(number).alias(f"min{i}"),
                           F.max(number).alias(f"max{i}"), F.avg(number).alias(f"mean{i}")]
        one = df.agg(*aggregates)
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col("n").alias("count"), F.col(f"nulls{i}").alias("nulls"),
                     F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"mean{i}").alias("mean"))
            for i, c in enumerate(wanted)
        ])
        return one.select(F.inline(rows))

    return step


def frequency_table(column: str) -> Step:
    """value, count and percent (two decimals), most frequent first; NULL is a value."""
    if not column:
        raise ValueError("frequency_table: column is required")

    def step(df: DataFrame) -> DataFrame:
        require(df, [column], "frequency_table")
        counts = df.groupBy(ref(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        total = counts.agg(F.sum("count").alias("total")).scalar()
        share = F.round(F.col("count") / total * 100, 2)
        return counts.withColumn("percent", share).orderBy(F.desc("count"), F.asc("value"))

    return step


def correlation(columns=None, digits: int | None = 4) -> Step:
    """Pearson's coefficient of all column pairs over the rows where both are numbers; 0 if undefined.

    One scan whatever the number of columns: up to PAIRS_PER_PASS pairs are aggregates, more come from products of
    blocks of rows, which tasks add up and send as one row per pair.
    """

    def step(df: DataFrame) -> DataFrame:
        wanted = require(df, names(columns) or [c for c in df.columns if is_number(dtype(df, c))], "correlation")
        pairs = list(combinations(wanted, 2))
        if not pairs:
            raise ValueError("correlation: at least two numeric columns are required")
        numbers = df.select(*[parse_double(ref(c), dtype(df, c)).alias(c) for c in wanted])
        return _pairs(numbers, pairs, digits) if len(pairs) <= PAIRS_PER_PASS else _by_blocks(numbers, wanted, digits)

    return step


def moments(numbers: DataFrame, origin: list[float]) -> DataFrame:
    """MOMENTS of all column pairs i < j over the rows where both are present: counts, sums and products around `origin`."""
    columns, at = len(numbers.columns), np.array(origin)
    upper = np.triu_indices(columns, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, columns, columns))
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, BLOCK_CELLS // columns)):
                block = batch.slice(first, max(1, BLOCK_CELLS // columns))
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in block.columns], 1).astype(np.float64)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in block.columns], 1)
                x = np.where(present > 0, x - at, 0.0)
                total += np.stack([present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x])
        n, s, q, c = total
        values = [n, s, s.T, q, q.T, c]  # s[i, j]: column i where j is present
        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)) for u in upper] + [pa.array(v[upper]) for v in values],
                                         [f.split()[0] for f in MOMENTS.split(", ")])

    found = numbers.mapInArrow(work, MOMENTS)
    return found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def _by_blocks(numbers: DataFrame, wanted: list[str], digits: int | None) -> DataFrame:
    """The coefficients from `moments` around a value of each column, or around the means where these lie far from it."""
    some = numbers.limit(1000).agg(*[F.first(ref(c), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(wanted)]).first()
    origin = [0.0 if v is None or not np.isfinite(v) else v for v in some]
    found = written(moments(numbers, origin), "moments")
    spread = lambda q, s: q - F.try_divide(s * s, F.col("n"))
    away = (F.col("x") / F.col("n")) ** 2 > FAR ** 2 * spread(F.col("xx"), F.col("x")) / F.col("n")
    away = away | ((F.col("y") / F.col("n")) ** 2 > FAR ** 2 * spread(F.col("yy"), F.col("y")) / F.col("n"))
    if not found.where("n > 0").where(away).isEmpty():
        means = numbers.agg(*[F.avg(ref(c)) for c in wanted]).first()
        found = moments(numbers, [o if v is None or not np.isfinite(v) else v for v, o in zip(means, origin, strict=True)])
    n = F.col("n")
    vx, vy = (F.when(spread(F.col(q), F.col(s)) > ROUNDING * F.col(q), spread(F.col(q), F.col(s))) for q, s in (("xx", "x"), ("yy", "y")))
    r = F.when(n > 1, F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n), F.sqrt(vx) * F.sqrt(vy)))
    r = F.coalesce(r, F.lit(0.0))
    labels = F.array(*[F.lit(c) for c in wanted])
    return found.select(F.get(labels, F.col("i")).alias("col1"), F.get(labels, F.col("j")).alias("col2"),
                        (r if digits is None else F.round(r, digits)).alias("pearson"))


def _pairs(numbers: DataFrame, pairs: list[tuple[str, str]], digits: int | None) -> DataFrame:
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = ref(a), ref(b)
        aggregates += [
            F.covar_samp(x, y).alias(f"c{i}"),
            F.stddev_samp(F.when(y.isNotNull(), x)).alias(f"x{i}"),
            F.stddev_samp(F.when(x.isNotNull(), y)).alias(f"y{i}"),
        ]
    rows = []
    for i, (a, b) in enumerate(pairs):
        r = F.coalesce(F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}")), F.lit(0.0))
        rows.append(F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"),
                             (r if digits is None else F.round(r, digits)).alias("pearson")))
    return numbers.agg(*aggregates).select(F.inline(F.array(*rows)))

"""Operators that need the rows in order, without ever using one partition.

A DataFrame has no arrival order, so each operator takes `order_by`. There are
two ways to cut the order into ranges that fit a task:

* `numbered` range-partitions the rows, sorts inside the partitions and writes
  the table to the shared folder; a row's sequence number is its partition and
  its place in it. This is right for any input: a lost executor, or an input
  that gives other rows when it is computed again, cannot change the numbers.
  The rows are counted first, so that ranges have at most about RANGE_ROWS rows
  where the shuffle partitions would be larger. Ties are broken by the row's content and exact
  copies by the task that read them, so the range partitioner can cut
  inside a hot key, and a group of copies between any two input tasks.
* `sliced` is for a stable input (one that gives the same rows each time it is
  read, such as a stored table): two passes over the first order column alone
  find slices of equal size, and each row computes its slice from its own value.
  It shuffles once and writes nothing. Where a slice would be too large for a
  task, the first way is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dtype, fresh, names, ref, require
from ..functions.parsing import is_blank
from ..session import written

Step = Callable[[DataFrame], DataFrame]
PLACE_BITS = 33  # monotonically_increasing_id(): partition above, place below
HOT_ROWS = 20_000_000
RANGE_ROWS = 1_000_000  # rows of a range, of which a task sorts one
ROWS_PER_SLICE = 100_000  # small inputs get fewer slices
SLICE_ROWS = 1_000_000  # a slice this small is never too large
MOST_CELLS = 1 << 18


def order_keys(order_by: str | Iterable, df: DataFrame) -> list[tuple[str, bool]]:
    """`"a, b desc"`, `["a", ("b", "desc")]` as (column, ascending) pairs."""
    items = order_by.split(",") if isinstance(order_by, str) else list(order_by)
    keys: list[tuple[str, bool]] = []
    for item in items:
        if isinstance(item, str):
            text = item.strip()
            name, direction = text, "asc"
            if text not in df.columns:
                head, _, tail = text.rpartition(" ")
                if tail.lower() in ("asc", "desc"):
                    name, direction = head.strip(), tail.lower()
        else:
            name, direction = item
            if isinstance(direction, bool):
                direction = "asc" if direction else "desc"
        if direction not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, got {direction!r}")
        keys.append((name, direction == "asc"))
    if not keys:
        raise ValueError("order_by is required: a DataFrame has no order of its own")
    require(df, [k for k, _ in keys], "order_by")
    return keys


def directed(name: str, ascending: bool) -> Column:
    return ref(name).asc_nulls_first() if ascending else ref(name).desc_nulls_last()


def _hashable(df: DataFrame) -> list[Column]:
    def plain(field: T.StructField) -> Column:
        text = field.dataType.simpleString()
        if "map<" in text or "variant" in text:
            return F.to_json(F.struct(ref(field.name)))
        return ref(field.name)

    return [plain(f) for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]


def row_hash(df: DataFrame) -> Column:
    """Content of a row as 64 bits: the tie-breaker between different rows."""
    return F.xxhash64(*_hashable(df))


def tie_broken(df: DataFrame, unique_order: bool, split_copies: bool = True) -> tuple[DataFrame, list[str]]:
    """Add tie-breaking columns; returns their names, to sort by after the order keys.

    Copies of a row in different input tasks differ by the number of the task,
    which is the same again where a task is retried; nothing is sorted for it.
    """
    if unique_order:
        return df, []
    h = fresh(df.columns, "__content")
    if not split_copies:
        return df.withColumn(h, row_hash(df)), [h]
    salt = fresh(df.columns, "__salt")
    return df.withColumns({h: row_hash(df), salt: F.spark_partition_id()}), [h, salt]


def ranges_needed(df: DataFrame, rows: int) -> int | None:
    """Ranges for so many rows where the session's shuffle partitions would be too large, else None."""
    needed = -(-rows // RANGE_ROWS)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def by_ranges(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """The rows in sorted ranges; adaptive execution may join small ones where their number is not given."""
    return df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)


@dataclass
class Numbered:
    """A written table whose `seq` column holds partition and place."""

    df: DataFrame
    seq: str

    def part(self) -> Column:
        return F.shiftright(ref(self.seq), PLACE_BITS)

    def place(self) -> Column:
        return ref(self.seq).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def position(self) -> Column:
        """The 0-based position over the whole table.

        The counts come to the driver as one row per partition.
        """
        counts = {r["p"]: r["n"] for r in self.df.groupBy(self.part().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        starts, total = [], 0
        for p in range(max(counts, default=-1) + 1):
            starts.append(total)
            total += counts.get(p, 0)
        if not starts:
            return F.lit(0).cast("bigint")
        return F.element_at(_longs(starts), (self.part() + 1).cast("int")) + self.place()


def numbered(df: DataFrame, keys: list[tuple[str, bool]], unique_order: bool = False) -> Numbered:
    """Sort globally and number the rows, with one count, one range shuffle and one write."""
    prepared, ties = tie_broken(df, unique_order)
    order = [directed(n, up) for n, up in keys] + [ref(t).asc() for t in ties]
    seq = fresh(df.columns, "__seq")
    table = by_ranges(prepared, order, ranges_needed(df, df.count())).withColumn(seq, F.monotonically_increasing_id()).drop(*ties)
    return Numbered(written(table, "numbered"), seq)


def order_number(name: str, kind: T.DataType) -> Column | None:
    """A double that never decreases as the column grows, or None for other types."""
    col = ref(name)
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        clock = F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
        return F.unix_date(col.cast("date")) * F.lit(86400.0) + clock
    if isinstance(kind, T.StringType):
        head = F.hex(F.substring(col.cast("binary"), 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    return None


@dataclass
class Sliced:
    """Rows with their slice number, and where each slice starts in the whole order."""

    df: DataFrame
    slice: str
    order: list[Column]
    starts: list[int]
    helpers: list[str]

    def position(self) -> Column:
        inside = F.row_number().over(Window.partitionBy(ref(self.slice)).orderBy(*self.order))
        return F.element_at(_longs(self.starts), ref(self.slice) + 1) + inside - 1


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")  # folded to one literal


def sliced(df: DataFrame, keys: list[tuple[str, bool]], unique_order: bool = False) -> Sliced | None:
    """Cut the order into slices by the value of its first column; None if that cannot be even.

    The first column's span is divided into cells and the rows of each cell are
    counted; neighbouring cells are then joined to slices of about ROWS_PER_SLICE
    rows, whatever the shuffle partitions are. The driver sees one count per cell, at most MOST_CELLS.
    """
    first, ascending = keys[0]
    number = order_number(first, dtype(df, first))
    if number is None:
        return None
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    span = df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = span["lo"] or 0.0, span["hi"] or 0.0, span["n"]
    slices = min(n // ROWS_PER_SLICE + 1, MOST_CELLS // 4)
    cells = min(64 * slices, MOST_CELLS)
    width = (hi - lo) / cells or 1.0
    cell = F.least(F.greatest(F.floor((number - lo) / width), F.lit(0)), F.lit(cells - 1))
    cell = F.when(F.isnan(number), F.lit(cells - 1)).otherwise(F.coalesce(cell, F.lit(0))).cast("int")
    if not ascending:
        cell = F.lit(cells - 1) - cell
    counts = {r["c"]: r["n"] for r in df.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(4 * n // slices, SLICE_ROWS)
    if max(counts.values(), default=0) > most:
        return None
    table, starts, filled, before = [], [0], 0, 0
    for c in range(cells):
        here = counts.get(c, 0)
        if filled and filled + here > n / slices:
            before += filled
            starts.append(before)
            filled = 0
        filled += here
        table.append(len(starts) - 1)
    prepared, ties = tie_broken(df, unique_order, split_copies=False)
    name = fresh(prepared.columns, "__slice")
    order = [directed(k, up) for k, up in keys] + [ref(t).asc() for t in ties]
    chosen = F.element_at(_longs(table), cell + 1).cast("int") if len(starts) > 1 else cell * 0
    rows = prepared.withColumn(name, chosen)
    if len(starts) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(len(starts), ref(name))  # else a task would get many slices
    return Sliced(rows, name, order, starts, [name, *ties])


def row_index(order_by, name: str = "_index", unique_order: bool = False, stable: bool = False) -> Step:
    """Add a gapless 0-based row number in the given order.

    `stable` says that the input gives the same rows each time it is read.
    """

    def step(df: DataFrame) -> DataFrame:
        keys = order_keys(order_by, df)
        cut = sliced(df, keys, unique_order) if stable else None
        if cut:
            return cut.df.withColumn(name, cut.position()).drop(*cut.helpers)
        table = numbered(df, keys, unique_order)
        return table.df.withColumn(name, table.position()).drop(table.seq)

    return step


def every_nth(n: int, order_by, unique_order: bool = False, stable: bool = False) -> Step:
    """The first row and each n-th after it."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def step(df: DataFrame) -> DataFrame:
        name = fresh(df.columns, "__at")
        return row_index(order_by, name, unique_order, stable)(df).filter(ref(name) % n == 0).drop(name)

    return step


def ffill(order_by, columns=None, limit: int | None = None, partition_by=None, unique_order: bool = False,
          stable: bool = False, hot_rows: int = HOT_ROWS) -> Step:
    """Replace missing values by the last present one before them."""
    return lambda df: _fill(df, order_by, columns, limit, partition_by, unique_order, stable, hot_rows, True)


def bfill(order_by, columns=None, limit: int | None = None, partition_by=None, unique_order: bool = False,
          stable: bool = False, hot_rows: int = HOT_ROWS) -> Step:
    """Replace missing values by the next present one after them."""
    return lambda df: _fill(df, order_by, columns, limit, partition_by, unique_order, stable, hot_rows, False)


def _fill(df, order_by, columns, limit, partition_by, unique_order, stable, hot_rows, forward) -> DataFrame:
    targets = require(df, names(columns) or df.columns, "fill")
    groups = require(df, names(partition_by), "fill partition_by")
    targets = [t for t in targets if t not in groups]
    if not targets:
        return df
    keys = [(n, up if forward else not up) for n, up in order_keys(order_by, df)]
    if limit is not None and limit < 0:
        limit = None
    if not groups:
        return _fill_in_parts(df, targets, keys, groups, limit, unique_order, stable)

    # Groups of an ordinary size are filled by a window; groups too large for one
    # task are cut into ranges. The counting job reads the group columns only.
    sizes = df.groupBy(*[ref(g) for g in groups]).agg(F.count(F.lit(1)).alias("__rows"))
    hot = sizes.filter(F.col("__rows") > hot_rows).drop("__rows")
    if hot.isEmpty():
        return _fill_windowed(df, targets, keys, groups, limit, unique_order)
    hot = hot.toDF(*[f"__hot_{i}" for i in range(len(groups))])
    same = [ref(g).eqNullSafe(F.col(f"__hot_{i}")) for i, g in enumerate(groups)]
    cold_part = _fill_windowed(df.join(hot, same, "left_anti"), targets, keys, groups, limit, unique_order)
    hot_part = _fill_in_parts(df.join(hot, same, "left_semi"), targets, keys, groups, limit, unique_order, stable)
    return cold_part.unionByName(hot_part)


def _fill_windowed(df, targets, keys, groups, limit, unique_order) -> DataFrame:
    prepared, ties = tie_broken(df, unique_order, split_copies=False)
    order = [directed(n, up) for n, up in keys] + [ref(t).asc() for t in ties]
    by_group = Window.partitionBy(*[ref(g) for g in groups]).orderBy(*order)
    so_far = by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = "__at"
    if limit is not None:
        prepared = prepared.withColumn(at, F.row_number().over(by_group).cast("bigint"))
    filled = {}
    for t in targets:
        present = ~is_blank(ref(t), dtype(df, t))
        value = F.last(F.when(present, ref(t)), ignorenulls=True).over(so_far)
        if limit is not None:
            seen = F.max(F.when(present, F.col(at))).over(so_far)
            value = F.when(F.col(at) - seen <= limit, value)
        filled[t] = F.when(present, ref(t)).otherwise(F.coalesce(value, ref(t)))
    return prepared.withColumns(filled).select(*[ref(c) for c in df.columns])


def _fill_in_parts(df, targets, keys, groups, limit, unique_order, stable) -> DataFrame:
    """Number the parts of the order, by slices or by ranges, and fill over them."""
    cut = sliced(df, keys, unique_order) if stable else None
    if cut and len(cut.starts) == 1:  # small enough for one task
        return _fill_windowed(cut.df, targets, keys, [cut.slice, *groups], limit, unique_order).drop(*cut.helpers)
    if cut:
        # Slices follow the order columns alone, so each holds a piece of every group.
        rows = cut.df.withColumn("__part", ref(cut.slice))
        piece = Window.partitionBy("__part", *[ref(g) for g in groups]).orderBy(*cut.order)
        rows = rows.withColumn("__at", F.row_number().over(piece).cast("bigint"))
        return _fill_over_parts(rows, df.columns, targets, groups, limit, cut.order, True)
    group_keys = [(g, True) for g in groups]
    table = numbered(df, group_keys + [k for k in keys if k[0] not in groups], unique_order)
    at = table.position() if limit is not None else ref(table.seq)
    rows = table.df.withColumns({"__part": table.part(), "__at": at})
    return _fill_over_parts(rows, df.columns, targets, groups, limit, [ref(table.seq)], False)


def _fill_over_parts(rows, columns, targets, groups, limit, order, from_part_start) -> DataFrame:
    """Fill over parts of the order: inside each part by a window, across parts by a carry.

    `__part` numbers the parts and `__at` grows with the order: by one per row of
    the group from the start of the part (`from_part_start`) or of the table. The
    carry is one row per part and group: the group's last present value before it.
    """
    here = [F.col("__part")] + [ref(g) for g in groups]
    so_far = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    summary = [F.count(F.lit(1)).alias("__n")]
    local = {}
    for i, t in enumerate(targets):
        present = ~is_blank(ref(t), dtype(rows, t))
        summary.append(F.max_by(ref(t), F.when(present, F.col("__at"))).alias(f"__last_{i}"))
        summary.append(F.max(F.when(present, F.col("__at"))).alias(f"__seen_{i}"))
        local[f"__here_{i}"] = F.last(F.when(present, ref(t)), ignorenulls=True).over(so_far)
        if limit is not None:
            local[f"__seen_here_{i}"] = F.max(F.when(present, F.col("__at"))).over(so_far)

    # One row per (part, group), so without groups as many rows as there are parts;
    # they form one run, keyed by an expression that is the same for all of them.
    before = (
        Window.partitionBy(*([ref(g) for g in groups] or [F.col("__part") < 0]))
        .orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("__n").over(before), F.lit(0)) if from_part_start else F.lit(0).cast("bigint")
    ends = rows.groupBy(*here).agg(*summary).withColumn("__start", start)
    carried = []
    for i, _ in enumerate(targets):
        seen = F.col(f"__seen_{i}")
        carried.append(F.last(F.when(seen.isNotNull(), F.col(f"__last_{i}")), ignorenulls=True).over(before).alias(f"__carry_{i}"))
        # From the carried row to where `__at` counts from.
        carried.append((F.col("__start") - F.max(F.col("__start") + seen).over(before)).alias(f"__gap_{i}"))
    carry = ends.select(
        F.col("__part").alias("__carry_part"), *[ref(g).alias(f"__carry_g{i}") for i, g in enumerate(groups)], *carried)
    carry = carry.filter(reduce(or_, [F.col(f"__gap_{i}").isNotNull() for i in range(len(targets))]))
    same = [F.col("__part") == F.col("__carry_part")] + [
        ref(g).eqNullSafe(F.col(f"__carry_g{i}")) for i, g in enumerate(groups)
    ]
    joined = rows.withColumns(local).join(carry, same, "left")
    filled = {}
    for i, t in enumerate(targets):
        value = F.coalesce(F.col(f"__here_{i}"), F.col(f"__carry_{i}"))
        if limit is not None:
            away = F.coalesce(F.col("__at") - F.col(f"__seen_here_{i}"), F.col("__at") + F.col(f"__gap_{i}"))
            value = F.when(away <= limit, value)
        present = ~is_blank(ref(t), dtype(rows, t))
        filled[t] = F.when(present, ref(t)).otherwise(F.coalesce(value, ref(t)))
    return joined.withColumns(filled).select(*[ref(c) for c in columns])

"""Cleaning text and dates inside a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import layout_to_pattern
from ..functions.names import dtype, is_integral, is_text, is_time, names, ref, require
from ..functions.parsing import as_text
from ..functions.patterns import template, translate

Step = Callable[[DataFrame], DataFrame]

# The Unicode white space trimmed from text, and what counts as special characters.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
SPECIAL = r"[^\p{L}\p{N}\s]+"
DATE_PARTS = ("year", "month", "day", "weekday", "hour", "minute", "second")


def trim_spaces(col: Column) -> Column:
    """Strip every kind of Unicode blank, not only U+0020."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def data_cleansing(columns=None, trim: bool = False, to_lower: bool = False, to_upper: bool = False,
                   remove_special: bool = False, nullify_empty: bool = False) -> Step:
    """Trim, change case, drop special characters and turn "" into NULL, in that order.

    Without `columns` all text columns are treated; a listed column of another
    type becomes text.
    """
    listed = names(columns)

    def step(df: DataFrame) -> DataFrame:
        wanted = require(df, listed, "data_cleansing") or [c for c in df.columns if is_text(dtype(df, c))]
        cleaned = {}
        for c in wanted:
            col = as_text(ref(c), dtype(df, c))
            if trim:
                col = trim_spaces(col)
            if to_lower:
                col = F.lower(col)
            if to_upper:
                col = F.upper(col)
            if remove_special:
                col = F.regexp_replace(col, translate(SPECIAL).java, "")
            if nullify_empty:
                col = F.nullif(col, F.lit(""))
            cleaned[c] = col
        return df.withColumns(cleaned) if cleaned else df

    return step


def find_replace(column: str, find: str, replace: str = "", mode: str = "contains") -> Step:
    """Replace text: the whole value (exact), each occurrence (contains) or a pattern (regex)."""
    if not column or find == "":
        raise ValueError("find_replace: column and find are required")
    if mode not in ("exact", "contains", "regex"):
        raise ValueError(f"find_replace: mode must be exact, contains or regex, got {mode!r}")

    def step(df: DataFrame) -> DataFrame:
        require(df, [column], "find_replace")
        col = as_text(ref(column), dtype(df, column))
        if mode == "exact":
            new = F.when(col == find, F.lit(replace)).otherwise(col)
        elif mode == "contains":
            new = F.replace(col, F.lit(find), F.lit(replace))
        else:
            pattern = translate(find)
            new = F.regexp_replace(col, pattern.java, template(replace, pattern))
        return df.withColumn(column, new)

    return step


def regex(column: str, pattern: str, mode: str = "extract", replace: str = "", output: str | None = None) -> Step:
    """extract: first group into `output`; replace: all matches; match: keep matching rows."""
    if not column or not pattern:
        raise ValueError("regex: column and pattern are required")
    if mode not in ("extract", "replace", "match"):
        raise ValueError(f"regex: mode must be extract, replace or match, got {mode!r}")
    compiled = translate(pattern)
    output = output or f"{column}_extracted"

    def step(df: DataFrame) -> DataFrame:
        require(df, [column], "regex")
        col = as_text(ref(column), dtype(df, column))
        if mode == "match":
            return df.filter(col.rlike(compiled.java))
        if mode == "replace":
            return df.withColumn(column, F.regexp_replace(col, compiled.java, template(replace, compiled)))
        if compiled.groups == 0:
            return df.withColumn(output, F.lit(""))
        return df.withColumn(output, F.coalesce(F.regexp_extract(col, compiled.java, 1), F.lit("")))

    return step


def text_to_columns(column: str, delimiter: str = ",", prefix: str | None = None, max_split: int | None = None) -> Step:
    """Split on a literal delimiter into prefix1..prefixN, each part trimmed.

    `max_split` fixes the number of columns and leaves the rest in the last one;
    without it one job finds the widest row.
    """
    if not column:
        raise ValueError("text_to_columns: column is required")
    delimiter = delimiter or ","
    prefix = prefix or f"{column}_"
    if max_split is not None and max_split < 1:
        raise ValueError("text_to_columns: max_split must be at least 1")

    def step(df: DataFrame) -> DataFrame:
        require(df, [column], "text_to_columns")
        literal = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts = F.split(as_text(ref(column), dtype(df, column)), literal, max_split or -1)
        width = max_split or df.agg(F.max(F.size(parts)).alias("n")).first()["n"] or 0
        return df.withColumns({f"{prefix}{i + 1}": trim_spaces(F.get(parts, F.lit(i))) for i in range(max(width, 0))})

    return step


def datetime(column: str, mode: str = "parse", input_format: str = "2006-01-02", output_format: str | None = None,
             add_unit: str = "days", add_value: float = 0, extract: str = "year", other: str | None = None,
             unit: str = "days", output: str | None = None) -> Step:
    """Reformat, shift, take apart or compare dates.

    Text is read with `input_format` and results are text in `output_format`;
    a date or timestamp column keeps its type unless a format is given. Text
    that is no date stays as it is when written back to the same column and is
    NULL in another one. `diff` counts whole units from `other` to `column`.
    """
    if not column:
        raise ValueError("datetime: column is required")
    if mode not in ("parse", "format", "add", "extract", "diff"):
        raise ValueError(f"datetime: unknown mode {mode!r}")
    if mode == "add" and add_unit not in ("days", "hours", "minutes"):
        raise ValueError(f"datetime: add_unit must be days, hours or minutes, got {add_unit!r}")
    if mode == "extract" and extract not in DATE_PARTS:
        raise ValueError(f"datetime: extract must be one of {DATE_PARTS}, got {extract!r}")
    if mode == "diff" and (not other or unit not in ("days", "hours", "minutes", "seconds")):
        raise ValueError("datetime: diff needs `other` and a unit of days, hours, minutes or seconds")
    target = output or column

    def moment(df: DataFrame, name: str) -> Column:
        kind = dtype(df, name)
        if is_time(kind):
            return ref(name)
        read = F.try_to_timestamp(as_text(ref(name), kind), F.lit(layout_to_pattern(input_format, parsing=True)))
        return read.cast("timestamp_ntz")  # wall-clock arithmetic, whatever the session's zone

    def step(df: DataFrame) -> DataFrame:
        require(df, [column] + ([other] if mode == "diff" else []), "datetime")
        typed = is_time(dtype(df, column))
        at = moment(df, column)
        if mode == "extract":
            if extract == "weekday":
                value, textual = F.date_format(at, "EEEE"), True
            else:
                part = {"year": F.year, "month": F.month, "day": F.dayofmonth,
                        "hour": F.hour, "minute": F.minute, "second": F.second}[extract]
                value, textual = part(at).cast("bigint"), False
        elif mode == "diff":
            one = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}[unit]
            value, textual = F.timestamp_diff(one, moment(df, other).cast("timestamp"), at.cast("timestamp")), False
        else:
            if mode == "add":
                steps = F.lit(int(add_value))
                interval = {"days": F.make_dt_interval(days=steps), "hours": F.make_dt_interval(hours=steps),
                            "minutes": F.make_dt_interval(mins=steps.cast("decimal(18,6)"))}[add_unit]
                at = at + interval
            textual = not typed or output_format is not None
            value = F.date_format(at, layout_to_pattern(output_format or "2006-01-02T15:04:05")) if textual else at
        if target == column and not typed:
            original = as_text(ref(column), dtype(df, column))
            value = F.coalesce(value if textual else value.cast("string"), original)
        return df.withColumn(target, value)

    return step

"""Two models fitted and applied in place: a line and a Gaussian classifier."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dtype, fresh, names, ref, require
from ..functions.parsing import number_or_zero, parse_double
from ..session import written
from .envelope import Classes
from .ordered import row_index

Step = Callable[[DataFrame], DataFrame]
VARIANCE_FLOOR = 1e-9
CLASSES_PER_EXPRESSION = 64
#: Numbers of a model that all tasks have.
MODEL_NUMBERS = 8_000_000


def regression(feature: str, target: str, output: str = "predicted", as_text: bool = False) -> Step:
    """Least-squares line of target on feature; adds the prediction, slope, intercept and r2.

    The line comes from one aggregation used as a scalar subquery. Without any
    numeric pair the result has no rows.
    """
    if not feature or not target:
        raise ValueError("regression: feature and target are required")

    def step(df: DataFrame) -> DataFrame:
        require(df, [feature, target], "regression")
        x, y = parse_double(ref(feature), dtype(df, feature)), parse_double(ref(target), dtype(df, target))
        line = df.agg(
            F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        )
        model = line.select(F.struct("n", "slope", "intercept", "r2").alias("line")).scalar()
        slope, intercept, r2 = (model.getField(f) for f in ("slope", "intercept", "r2"))
        columns = {output: slope * x + intercept, "slope": slope, "intercept": intercept, "r2": r2}
        if as_text:
            columns.update(slope=F.format_string("%.6f", slope), intercept=F.format_string("%.6f", intercept),
                           r2=F.format_string("%.4f", r2))
        return df.filter(model.getField("n") > 0).withColumns(columns)

    return step


def naive_bayes(features, target: str, output: str = "predicted_class") -> Step:
    """Gaussian naive Bayes trained and applied on the same rows.

    The model is one row per class. A few classes become an expression; more
    become arrays that every task has, with an index of the classes that can be best near a row, so
    that most are never scored (`envelope.py`), all in one job. Beyond MODEL_NUMBERS numbers the model
    is taken in parts, each of which goes over the rows once. Scoring needs no shuffle. Equal scores go to the greatest class.
    """
    columns = names(features)
    if not columns or not target:
        raise ValueError("naive_bayes: features and target are required")

    def step(df: DataFrame) -> DataFrame:
        require(df, columns + [target], "naive_bayes")
        values = [number_or_zero(ref(c), dtype(df, c)) for c in columns]
        model = df.groupBy(ref(target).alias("class")).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(v).alias(f"mean{i}") for i, v in enumerate(values)],
            *[F.greatest(F.var_pop(v), F.lit(VARIANCE_FLOOR)).alias(f"var{i}") for i, v in enumerate(values)],
            *[f(F.when(F.abs(v) < F.lit(math.inf), v)).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i, v in enumerate(values)],
        )
        few = model.limit(CLASSES_PER_EXPRESSION + 1).collect()
        kind = dtype(df, target)
        if not few:
            return df.withColumn(output, F.lit(None).cast(kind))
        if len(few) <= CLASSES_PER_EXPRESSION:
            total = sum(r["n"] for r in few)
            return df.withColumn(output, F.array_max(F.array(*[_score(r, total, values, kind) for r in few])).getField("class"))
        return _by_arrays(df, model, values, kind, output)

    return step


def _by_arrays(df: DataFrame, model: DataFrame, values: list[Column], kind, output: str) -> DataFrame:
    """Score against arrays of classes in ascending order, in parts of MODEL_NUMBERS numbers."""
    indexed = written(row_index("class", "__i", unique_order=True)(model), "classes")
    ends = [f(f"{c}{i}").alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(len(values))]
    size = indexed.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), *ends).first()
    low, high = (np.array([size[f"{c}{i}"] for i in range(len(values))], np.float64) for c in ("low", "high"))
    part = max(1, MODEL_NUMBERS // (2 * len(values) + 1))
    best, scored = fresh(df.columns, "__best"), df
    for start in range(0, size["k"], part):
        numbers = [f"{c}{i}" for c in ("mean", "var") for i in range(len(values))]
        rows = indexed.filter(F.col("__i").between(start, start + part - 1)).orderBy("__i").select("class", "n", *numbers).toArrow()
        top = _best_class(rows, size["n"], low, high, kind)(*values)
        scored = scored.withColumn(best, F.greatest(ref(best), top) if start else top)
        if start:
            scored = written(scored, "scored")
    return scored.withColumn(output, ref(best).getField("class")).drop(best)


def _best_class(model: pa.Table, total: int, low: np.ndarray, high: np.ndarray, kind):
    """A function of the feature columns that gives struct(score, class) of the best class, the greatest of equal ones."""
    cloudpickle.register_pickle_by_value(sys.modules[Classes.__module__])  # executors need no copy of this package
    classes = model.column("class").combine_chunks()
    mean, var = (np.stack([model.column(f"{c}{i}").to_numpy() for i in range(len(low))]) for c in ("mean", "var"))
    constant = np.array([math.log(n / total) for n in model.column("n").to_pylist()])
    for v in var:
        constant = constant - 0.5 * np.array([math.log(2 * math.pi * x) for x in v])
    index = Classes(mean, var, constant, low, high)

    def best(*columns: pa.Array) -> pa.Array:
        score, at = index.best(np.stack([c.to_numpy(zero_copy_only=False) for c in columns]))
        return pa.StructArray.from_arrays([pa.array(score), classes.take(pa.array(at))], ["score", "class"])

    return F.arrow_udf(best, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("class", kind)]))


def _score(row: Row, total: int, values: list[Column], kind) -> Column:
    constant = math.log(row["n"] / total)
    score = None
    for i, value in enumerate(values):
        mean, variance = row[f"mean{i}"], row[f"var{i}"]
        constant -= 0.5 * math.log(2 * math.pi * variance)
        away = value - F.lit(mean)
        term = away * away / F.lit(2 * variance)
        score = term if score is None else score + term
    return F.struct((F.lit(constant) - score).alias("score"), F.lit(row["class"]).cast(kind).alias("class"))

"""Change rows (`_op` = INSERT, UPDATE, DELETE) applied to a snapshot."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import names, ref, require
from .ordered import row_hash

OPERATIONS = ("INSERT", "UPDATE", "DELETE")
SEQUENCE, DELETED = "__sequence", "__deleted"


def last_changes(changes: DataFrame, keys, sequence: str) -> DataFrame:
    """The newest change of each key, combined on the map side."""
    keys = require(changes, names(keys), "last_changes")
    require(changes, [sequence], "last_changes")
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*[ref(c) for c in rest]), F.struct(ref(sequence), row_hash(changes))).alias("__row")
    last = changes.groupBy(*[ref(k) for k in keys]).agg(newest)
    return last.select(*[ref(c) if c in keys else F.col("__row").getField(c).alias(c) for c in changes.columns])


def checked(changes: DataFrame, op_column: str) -> DataFrame:
    """The changes with their operation in upper case; another operation fails the job when a row of it is read."""
    op = F.upper(ref(op_column))
    wrong = F.raise_error(F.concat(F.lit(f"{op_column} must be one of {OPERATIONS}, got "), F.coalesce(ref(op_column), F.lit("NULL"))))
    return changes.withColumn(op_column, F.when(op.isin(*OPERATIONS), op).otherwise(wrong.cast("string")))


def apply_changes(snapshot: DataFrame, changes: DataFrame, keys, sequence: str, op_column: str = "_op") -> DataFrame:
    """The snapshot after all changes: rows of touched keys give way to their last image.

    A change whose operation is NULL or none of OPERATIONS (in any case) fails the job.
    """
    keys = require(snapshot, names(keys), "apply_changes")
    require(changes, [op_column, *snapshot.columns], "apply_changes")
    last = last_changes(checked(changes, op_column), keys, sequence)
    touched = last.select(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [ref(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    untouched = snapshot.join(touched, same, "left_anti")
    images = last.filter(ref(op_column) != "DELETE").select(*[ref(c) for c in snapshot.columns])
    return untouched.unionByName(images)


def with_state(snapshot: DataFrame, changes: DataFrame, sequence: str) -> DataFrame:
    """A snapshot as the state that `apply_newer` keeps: the sequence last applied to a row and whether that deleted it."""
    kind = changes.schema[sequence].dataType
    return snapshot.withColumn(SEQUENCE, F.lit(None).cast(kind)).withColumn(DELETED, F.lit(False))


def apply_newer(state: DataFrame, changes: DataFrame, keys, sequence: str, op_column: str = "_op") -> DataFrame:
    """The state after the changes that are newer than what was applied to their key before.

    Deleted keys stay as tombstones, so changes may come in any order over any
    number of calls. A change of an equal sequence counts as applied.
    """
    keys = require(state, names(keys), "apply_newer")
    columns = [c for c in state.columns if c not in (SEQUENCE, DELETED)]
    require(changes, [op_column, *columns], "apply_newer")
    last = last_changes(checked(changes, op_column), keys, sequence)
    images = last.select(*[ref(c) for c in columns], ref(sequence).alias(SEQUENCE), (ref(op_column) == "DELETE").alias(DELETED))
    hidden = {k: f"__k{i}" for i, k in enumerate(keys)}
    same = reduce(and_, [ref(k).eqNullSafe(F.col(h)) for k, h in hidden.items()])
    known = state.groupBy(*[ref(k).alias(h) for k, h in hidden.items()]).agg(F.max(SEQUENCE).alias("__known"))
    newer = images.join(known, same, "left").where(F.col("__known").isNull() | (F.col(SEQUENCE) > F.col("__known"))).drop(*hidden.values(), "__known")
    touched = newer.select(*[ref(k).alias(h) for k, h in hidden.items()])
    return state.join(touched, same, "left_anti").unionByName(newer)


def upsert(table: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """The table with `rows` replacing or joining its rows by key; a repeated key keeps one row."""
    keys = require(table, names(keys), "upsert")
    rows = rows.select(*[ref(c) for c in require(rows, table.columns, "upsert")]).dropDuplicates(keys)
    touched = rows.select(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [ref(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return table.join(touched, same, "left_anti").unionByName(rows)

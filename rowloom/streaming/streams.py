"""Streaming forms of the operators.

The row-wise steps (select, rename, cast, add_column, filter, route, unpivot,
cleaning, fillna with a value, union) work on a streaming DataFrame as they
are. Here are those that keep state or write.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.names import dtype, names, ref, require
from ..operators.changes import DELETED, SEQUENCE, apply_newer, with_state
from ..operators.joins import join
from ..session import delete_folder, folders, new_folder
from .store import stream_id


def read_folder(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None,
                files_per_trigger: int | None = None, format: str = "parquet") -> DataFrame:
    """Files appearing in a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_dedup(stream: DataFrame, keys, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    keys = require(stream, names(keys), "stream_dedup")
    if dtype(stream, event_time).simpleString() != "timestamp":
        stream = stream.withColumn(event_time, ref(event_time).cast("timestamp"))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def lookup_join(stream: DataFrame, table: DataFrame, stream_key: str, table_key: str, how: str = "inner") -> DataFrame:
    """Join each stream row with a table; the table is the inner or optional side."""
    if how not in ("inner", "left"):
        raise ValueError("lookup_join: how must be inner or left; rows of the table have no end of stream")
    return join(stream, table, stream_key, table_key, how)


def run_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there, write it as parquet, and return the written rows."""
    spark = stream.sparkSession
    path = path or new_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or new_folder(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def apply_change_stream(changes: DataFrame, snapshot_path: str, keys, sequence: str, checkpoint: str, op_column: str = "_op",
                        available_now: bool = False) -> StreamingQuery:
    """Keep a snapshot up to date with a stream of change rows, whatever the order in which they come.

    `snapshot_path/version=start` must hold the initial rows. Each batch reads
    the newest version and writes the next one, with the sequence last applied to
    each key and tombstones of deleted ones. A version counts once its entry in
    `snapshot_path/commits` is complete; the entry holds the last batch of every stream, so a
    batch that comes again is passed over, and a stream with a new checkpoint
    goes on from the newest version. The newest two versions are kept;
    `read_snapshot` gives the newest rows. `checkpoint` must outlive the process.

    A batch costs a rewrite of the snapshot. Where that is much larger than a
    batch, keep the rows in a `ChangeStore` and use `store_change_stream`.
    """
    if not checkpoint:
        raise ValueError("apply_change_stream: checkpoint is required")

    def next_version(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream, known = stream_id(session, checkpoint), _commits(snapshot_path)
        streams = _streams(session, snapshot_path, known[-1]) if known else {}
        if streams.get(stream, -1) >= batch_id:
            return
        if known:
            state, version = session.read.parquet(f"{snapshot_path}/version={known[-1]}"), known[-1] + 1
        else:
            state, version = with_state(session.read.parquet(f"{snapshot_path}/version=start"), batch, sequence), 0
        apply_newer(state, batch, keys, sequence, op_column).write.mode("overwrite").parquet(f"{snapshot_path}/version={version}")
        entry = session.createDataFrame([(json.dumps({**streams, stream: batch_id}),)], "value string").coalesce(1)
        entry.write.mode("overwrite").text(f"{snapshot_path}/commits/{version:020d}")
        for old in known[:-1]:
            delete_folder(f"{snapshot_path}/commits/{old:020d}")
            delete_folder(f"{snapshot_path}/version={old}")

    writer = changes.writeStream.foreachBatch(next_version).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _commits(snapshot_path: str) -> list[int]:
    """The complete versions, in order."""
    path = f"{snapshot_path}/commits"
    return sorted(int(v) for v in folders(path) if v.isdigit() and folders(f"{path}/{v}", "_SUCCESS"))


def _streams(spark: SparkSession, snapshot_path: str, version: int) -> dict[str, int]:
    return json.loads(spark.read.text(f"{snapshot_path}/commits/{version:020d}").first()["value"])


def read_snapshot(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """The rows of the newest version that `apply_change_stream` has written, without its own columns."""
    known = _commits(snapshot_path)
    if not known:
        raise ValueError(f"read_snapshot: no version in {snapshot_path}")
    return spark.read.parquet(f"{snapshot_path}/version={known[-1]}").where(f"not {DELETED}").drop(SEQUENCE, DELETED)


def per_batch(step: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies a batch-only step and appends the result, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write

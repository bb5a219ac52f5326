"""A table kept up to date by batches of change rows, each of which writes about what it brings.

The table lies in buckets by a hash of the key. A batch is written as a delta:
the last change of each key, with its sequence and the version that brought it.
Nothing is read for that but the batch. Reading joins the buckets' rows with
the deltas that they do not hold yet. The rest is done in proportion:

* Deltas of about one size are merged as soon as there are FAN of them, so a
  change is rewritten a logarithmic number of times and deltas stay few.
* A bucket whose pending changes reach a share of its rows is rewritten with
  them, alone; the other buckets' files stay as they are.

A version is a manifest: one row per bucket (its folder, the version up to
which it holds changes, its rows, its pending changes) and the list of deltas.
It is written last, under a new name, and counts once it is complete; until
then readers see the version before it, and what a failed attempt has left is
written anew. The manifest holds the last batch of each stream, so a batch that
comes again is passed over and a stream with a new checkpoint goes on from the
newest version. One writer at a time: a second one that meets a version that
is there already is refused.

The change with the greatest sequence counts, whatever the order in which
changes come; of equal ones the first that came. A change without a sequence
gives way to any that has one, and to a later one without. Deleted keys stay as tombstones. Keys may be null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import names, ref, require
from ..operators.changes import DELETED, SEQUENCE, checked, last_changes
from ..session import delete_folder, folders

BUCKET, VERSION, PART = "__bucket", "__version", "part"
#: Rows of a bucket at the start, buckets at most, deltas of one size that are merged.
BUCKET_ROWS, MOST_BUCKETS, FAN = 1_000_000, 65_536, 8
#: Pending changes for which a bucket is rewritten: a share of its rows, and at least so many.
SHARE, LEAST_PENDING = 0.25, 10_000

ENTRIES = "bucket int, folder string, upto long, rows long, pending long, meta string"


@dataclass(frozen=True)
class Delta:
    folder: str
    level: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    """A version of a store."""

    version: int
    keys: tuple[str, ...]
    schema: str
    streams: dict[str, int] = field(default_factory=dict)
    deltas: tuple[Delta, ...] = ()
    folder: tuple[str | None, ...] = ()
    upto: tuple[int, ...] = ()
    rows: tuple[int, ...] = ()
    pending: tuple[int, ...] = ()


class ChangeStore:
    """A store in the folder `path`; `create` makes one, `apply` brings changes in, `read` gives the rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, snapshot: DataFrame, path: str, keys, sequence: T.DataType | str, buckets: int | None = None) -> ChangeStore:
        """Start a store with the rows of `snapshot`; `sequence` is the type of the changes' sequence.

        Without `buckets` their number follows from the row count.
        """
        store = cls(snapshot.sparkSession, path)
        if store._versions():
            raise ValueError(f"ChangeStore: {path} holds a store already")
        keys = tuple(require(snapshot, names(keys), "ChangeStore"))
        if not keys:
            raise ValueError("ChangeStore: keys are required")
        kind = T.StructType.fromDDL(f"s {sequence}").fields[0].dataType if isinstance(sequence, str) else sequence
        if buckets is None:
            buckets = max(1, min(MOST_BUCKETS, -(-snapshot.count() // BUCKET_ROWS)))
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"ChangeStore: buckets must be between 1 and {MOST_BUCKETS}, got {buckets}")
        state = snapshot.withColumns({SEQUENCE: F.lit(None).cast(kind), DELETED: F.lit(False)})
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema.fields])
        store._restart(Manifest(-1, keys, schema.json()), state, buckets)
        return store

    # ---- manifests ---------------------------------------------------------

    def _versions(self) -> list[int]:
        """The complete versions, in order."""
        return sorted(int(v) for v in folders(f"{self.path}/manifest") if v.isdigit() and folders(f"{self.path}/manifest/{v}", "_SUCCESS"))

    def manifest(self) -> Manifest:
        """The newest version."""
        found = self._versions()
        if not found:
            raise ValueError(f"ChangeStore: no store in {self.path}")
        entries = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/manifest/{found[-1]:020d}").orderBy("bucket").collect()
        meta = json.loads(entries[0]["meta"])
        buckets = entries[1:]
        return Manifest(meta["version"], tuple(meta["keys"]), meta["schema"], meta["streams"], tuple(Delta(**d) for d in meta["deltas"]),
                        *(tuple(r[c] for r in buckets) for c in ("folder", "upto", "rows", "pending")))

    def _commit(self, new: Manifest) -> None:
        """Write a version, then drop the one before the last and what no version left uses."""
        path = f"{self.path}/manifest/{new.version:020d}"
        known = self._versions()
        if known and known[-1] >= new.version:
            raise RuntimeError(f"ChangeStore: version {new.version} was written by another writer")
        delete_folder(path)  # what an attempt that failed has left
        meta = json.dumps({"version": new.version, "keys": new.keys, "schema": new.schema, "streams": new.streams, "deltas": [vars(d) for d in new.deltas]})
        entries = [(-1, None, None, None, None, meta)]
        entries += [(b, *row, None) for b, row in enumerate(zip(new.folder, new.upto, new.rows, new.pending, strict=True))]
        self.spark.createDataFrame(entries, ENTRIES).coalesce(1).write.parquet(path)
        for version in known[:-1]:
            delete_folder(f"{self.path}/manifest/{version:020d}")
        used = {d.folder for m in (new, self._at(known[-1]) if known else new) for d in m.deltas} | {
            f.split("/")[0] for m in (new, self._at(known[-1]) if known else new) for f in m.folder if f}
        for folder in folders(f"{self.path}/data"):
            if folder not in used:
                delete_folder(f"{self.path}/data/{folder}")

    def _at(self, version: int) -> Manifest:
        rows = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/manifest/{version:020d}").select("folder", "meta").collect()
        meta = next(json.loads(r["meta"]) for r in rows if r["meta"])
        return Manifest(version, (), "", {}, tuple(Delta(**d) for d in meta["deltas"]), tuple({r["folder"] for r in rows if r["folder"]}))

    def _new(self, kind: str, version: int) -> str:
        return f"{kind}-{version:020d}-{uuid.uuid4().hex}"

    # ---- rows --------------------------------------------------------------

    def _state(self, at: Manifest) -> T.StructType:
        return T.StructType.fromJson(json.loads(at.schema))

    def _bucket(self, at: Manifest, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*[ref(k) for k in at.keys]), F.lit(buckets or len(at.folder))).cast("int")

    def _base(self, at: Manifest, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType([*self._state(at).fields, T.StructField(BUCKET, T.IntegerType())])
        paths = [f"{self.path}/data/{at.folder[b]}" for b in (range(len(at.folder)) if only is None else only) if at.folder[b]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _pending(self, at: Manifest, deltas: tuple[Delta, ...] | None = None, only: list[int] | None = None) -> DataFrame:
        """The changes of the deltas that the buckets do not hold yet, the newest of each key."""
        schema = T.StructType([*self._state(at).fields, T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        paths = [f"{self.path}/data/{d.folder}" for d in (at.deltas if deltas is None else deltas)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(only))
        held = self.spark.createDataFrame(list(enumerate(at.upto)), "__b int, __upto long")
        rows = rows.join(held, F.col(BUCKET) == F.col("__b")).where(F.col(VERSION) > F.col("__upto")).drop("__b", "__upto")
        rest = [c for c in rows.columns if c not in at.keys]
        came = F.when(F.col(SEQUENCE).isNull(), F.col(VERSION)).otherwise(-F.col(VERSION))
        newest = rows.groupBy(*[ref(k) for k in at.keys]).agg(F.max_by(F.struct(*[ref(c) for c in rest]), F.struct(SEQUENCE, came)).alias("__row"))
        return newest.select(*[ref(c) if c in at.keys else F.col("__row").getField(c).alias(c) for c in rows.columns])

    def _merged(self, at: Manifest, only: list[int] | None = None) -> DataFrame:
        """All rows with their pending changes, tombstones included."""
        base = self._base(at, only)
        if not at.deltas:
            return base
        pending = self._pending(at, only=only)
        hidden = {k: f"__k{i}" for i, k in enumerate(at.keys)}
        same = reduce(and_, [ref(k).eqNullSafe(F.col(h)) for k, h in hidden.items()])
        changed = pending.select(*[ref(k).alias(h) for k, h in hidden.items()])
        # few rows of the table have a sequence and pending changes as well, so the narrow side is found first
        known = base.where(F.col(SEQUENCE).isNotNull()).join(changed, same, "left_semi").select(*[ref(k).alias(h) for k, h in hidden.items()], F.col(SEQUENCE).alias("__known"))
        newer = pending.join(known, same, "left").where(F.col("__known").isNull() | (F.col(SEQUENCE) > F.col("__known"))).drop("__known", *hidden.values(), VERSION)
        touched = newer.select(*[ref(k).alias(h) for k, h in hidden.items()])
        return base.join(touched, same, "left_anti").unionByName(newer)

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._merged(self.manifest()).where(f"not {DELETED}").drop(SEQUENCE, DELETED, BUCKET)

    # ---- writing -----------------------------------------------------------

    def _write_base(self, rows: DataFrame, at: Manifest, version: int) -> tuple[str, dict[int, int]]:
        """Write whole buckets; the folder and the rows of each bucket."""
        folder = self._new("base", version)
        path = f"{self.path}/data/{folder}"
        rows.withColumn(PART, F.col(BUCKET)).repartition(BUCKET).write.partitionBy(PART).parquet(path)
        schema = T.StructType([T.StructField(BUCKET, T.IntegerType())])
        stored = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        return folder, {r[BUCKET]: r["n"] for r in stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}

    def _restart(self, at: Manifest, state: DataFrame, buckets: int) -> None:
        version = at.version + 1
        folder, sizes = self._write_base(state.withColumn(BUCKET, self._bucket(at, buckets)), at, version)
        self._commit(replace(
            at, version=version, deltas=(), folder=tuple(f"{folder}/{PART}={b}" if b in sizes else None for b in range(buckets)),
            upto=(version,) * buckets, rows=tuple(sizes.get(b, 0) for b in range(buckets)), pending=(0,) * buckets))

    def rebucket(self, buckets: int) -> None:
        """Write the whole table with another number of buckets, as after it has grown."""
        at = self.manifest()
        self._restart(at, self._merged(at).drop(BUCKET), buckets)

    def apply(self, changes: DataFrame, sequence: str, op_column: str = "_op", stream: str | None = None, batch: int | None = None) -> bool:
        """Bring a batch of change rows in; False if the store has this batch of this stream already.

        Operations are those of `apply_changes`; another one fails the job before anything is committed.
        """
        at = self.manifest()
        if stream is not None and batch is not None and at.streams.get(stream, -1) >= batch:
            return False
        state = self._state(at)
        columns = [f.name for f in state.fields if f.name not in (SEQUENCE, DELETED)]
        require(changes, [op_column, sequence, *columns], "ChangeStore")
        version = at.version + 1
        last = last_changes(checked(changes, op_column), list(at.keys), sequence)
        images = last.select(*[ref(f.name).cast(f.dataType).alias(f.name) for f in state.fields if f.name in columns],
                             ref(sequence).cast(state[SEQUENCE].dataType).alias(SEQUENCE), (ref(op_column) == "DELETE").alias(DELETED),
                             F.lit(version).cast("long").alias(VERSION))
        delta, counts = self._write_delta(images.withColumn(BUCKET, self._bucket(at)), version, 0)
        streams = at.streams if stream is None or batch is None else {**at.streams, stream: batch}
        pending = tuple(n + counts.get(b, 0) for b, n in enumerate(at.pending))
        new = replace(at, version=version, streams=streams, pending=pending, deltas=(*at.deltas, delta) if delta.rows else at.deltas)
        full = [b for b, n in enumerate(pending) if n >= max(SHARE * new.rows[b], LEAST_PENDING)]
        self._commit(self._levelled(self._rewritten(new, full) if full else new))
        return True

    def compact(self) -> None:
        """Rewrite every bucket that has pending changes."""
        at = self.manifest()
        full = [b for b, n in enumerate(at.pending) if n]
        if full:
            self._commit(self._rewritten(replace(at, version=at.version + 1), full))

    def _write_delta(self, rows: DataFrame, version: int, level: int) -> tuple[Delta, dict[int, int]]:
        folder = self._new("delta", version)
        rows.sortWithinPartitions(BUCKET).write.parquet(f"{self.path}/data/{folder}")  # a bucket's changes lie together
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}")
        counts = {r[BUCKET]: r["n"] for r in stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
        return Delta(folder, level, sum(counts.values())), counts

    def _rewritten(self, new: Manifest, full: list[int]) -> Manifest:
        """The version with the pending changes of some buckets in their rows."""
        folder, sizes = self._write_base(self._merged(new, full), new, new.version)
        change = {b: (f"{folder}/{PART}={b}" if b in sizes else None, new.version, sizes.get(b, 0), 0) for b in full}
        rows = [change.get(b, row) for b, row in enumerate(zip(new.folder, new.upto, new.rows, new.pending, strict=True))]
        folder_, upto, many, pending = zip(*rows, strict=True)
        return replace(new, folder=folder_, upto=upto, rows=many, pending=pending, deltas=new.deltas if any(pending) else ())

    def _levelled(self, new: Manifest) -> Manifest:
        """The version with deltas of one level merged where there are FAN of them."""
        level = 0
        while any(d.level >= level for d in new.deltas):
            same = tuple(d for d in new.deltas if d.level == level)
            if len(same) >= FAN:
                merged, _ = self._write_delta(self._pending(new, same), new.version, level + 1)
                rest = tuple(d for d in new.deltas if d.level != level)
                new = replace(new, deltas=(*rest, merged) if merged.rows else rest)
            level += 1
        return new


def store_change_stream(changes: DataFrame, store: ChangeStore, sequence: str, checkpoint: str, op_column: str = "_op",
                        available_now: bool = False) -> StreamingQuery:
    """Bring a stream of change rows into a store, each batch once.

    The stream is known by the id in its checkpoint, which must outlive the process. A stream with a
    new checkpoint is another stream: it starts from the newest version and loses nothing.
    """
    if not checkpoint:
        raise ValueError("store_change_stream: checkpoint is required")

    def bring(batch: DataFrame, batch_id: int) -> None:
        ChangeStore(batch.sparkSession, store.path).apply(batch, sequence, op_column, stream_id(batch.sparkSession, checkpoint), batch_id)

    writer = changes.writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream has for as long as its checkpoint exists."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]

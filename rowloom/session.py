"""The session and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.names import ref

_local_dirs: dict[str, str] = {}
_folders: list[str] = []


def session(app: str = "rowloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.legacy.javaCharsets": "true",  # Spark 4 refuses windows-1252 otherwise
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Where it is unset a temporary folder serves on a local master only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="rowloom-")
    return _local_dirs[key]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/rowloom/{label}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result no longer depends on executor memory or on a recomputation
    giving rows in the same order, and its columns can be pruned.
    """
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    stored = df.drop(*void) if void else df
    path = new_folder(df.sparkSession, label)
    stored.write.parquet(path)
    back = df.sparkSession.read.schema(stored.schema).parquet(path)
    if void:
        back = back.select(*[F.lit(None).alias(c) if c in void else ref(c) for c in df.columns])
    return back


class Scratch:
    """The folders that `written` and others make from here on."""

    def __init__(self) -> None:
        self.first, self.kept = len(_folders), set()

    def keep_last(self) -> None:
        """The folder made last is the result."""
        self.kept.update(_folders[-1:])


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete at the end the folders made inside, but for those that are kept; what is read later must be among these."""
    made = Scratch()
    yield made
    for folder in [f for f in _folders[made.first:] if f not in made.kept]:
        _folders.remove(folder)
        delete_folder(folder)


def remove_written(spark: SparkSession) -> int:
    """Delete this process's folders in the shared folder, once no DataFrame built on them is needed."""
    removed = 0
    while _folders:
        removed += delete_folder(_folders.pop())
    return removed


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder, on any store that pyarrow reaches."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def folders(uri: str, name: str | None = None) -> list[str]:
    """The names in a folder, or those equal to `name`; none where there is no folder."""
    store, path = _store(uri)
    found = [i.base_name for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    return sorted(f for f in found if name in (None, f))


def delete_folder(uri: str) -> bool:
    """Delete a folder of this library's own, on any store that pyarrow reaches; whether it was there."""
    store, path = _store(uri)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return False
    store.delete_dir(path)
    return True

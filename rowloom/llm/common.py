"""Parts that several operators use: stores, blocks of texts, hashing and folded sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder or file, local or remote."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def own_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def text_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key` and the whole `text` (null: empty) only, so that no other column can clash."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], chars: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that a block's texts have about `chars` characters; a longer text is a block by itself. Only its texts are Python's."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
            if i > start and size + n > chars:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        yield batch.slice(start), column.slice(start).to_pylist()
        del batch, column  # before the next one is read


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (a multiply and xor-shift finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Say in a task that this worker process may keep things of `owner`, which `clear` drops; what others kept is dropped.

    Workers serve one operator after the other, and together their tables would be too large.
    """
    let_go(owner)
    _held[owner] = clear


def let_go(but: str = "") -> None:
    """Say in a task that this worker process needs nothing that operators other than `but` kept."""
    others = [o for o in _held if o != but]
    for other in others:
        _held.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()


def prefix_sums(counts: dict) -> dict:
    """The sum of all values before each key, in the order of the keys."""
    total, out = 0, {}
    for key in sorted(counts):
        out[key] = total
        total += counts[key]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that copy the ranges [start, start + length) one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def parts_of(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

"""Token ids as flat binary files (operator 2).

A shard holds the documents of one range of ids: `<name>.bin` has the token
ids of its documents one after the other as little-endian unsigned integers
(16 bits wide if the vocabulary fits, else 32), `<name>.idx` has, for n
documents, n + 1 64-bit offsets in ids, then n 64-bit document ids, then n
bytes that are 1 where the document id is null. A shard's first id in the
whole corpus is the sum of the sizes of the shards before it.

Null or empty texts have the end id only. Rows with a null document id come
first; repeated rows are all written, in no defined order among themselves.
An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import blocks, own_name, parts_of, prefix_sums, store, text_of
from .tokens import BLOCK_CHARS, encoder, vocabulary_size

SHARDS = "part int, name string, folder string, width int, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"
#: Ids handed to Spark in one Arrow batch, about.
READ_IDS = 2_000_000


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id",
              text: str = "text", shards: int | None = None) -> tuple[DataFrame, str]:
    """Write all documents in ascending order of `key`; gives the list of shards, with their first id, and the folder.

    Each task writes files under names of its own and reports them in a
    table that Spark commits, so the files of a lost attempt are never read.
    The driver receives one row per shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")
    width = 2 if vocabulary_size(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = encoder(tokenizer)
        fs, path = store(folder)
        name = own_name("ids", "")
        offsets, keys, nulls, total, out = [np.zeros(1, np.int64)], [], [], 0, None
        try:
            for block, texts in blocks(batches, BLOCK_CHARS):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.bin")
                ids, counts = table.encode(texts)
                ends = np.cumsum(counts)
                full = np.insert(ids, ends, end_id)
                out.write(full.astype(f"<u{width}").tobytes())
                offsets.append(total + ends + np.arange(1, len(texts) + 1))
                total += len(full)
                column = block.column(0)
                keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        with fs.open_output_stream(f"{path}/{name}.idx") as side:
            for part in (np.concatenate(offsets).astype("<i8"), np.concatenate(keys), np.concatenate(nulls)):
                side.write(part.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "folder": [folder],
            "width": pa.array([width], pa.int32()), "docs": pa.array([sum(map(len, keys))], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = text_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange(shards or parts_of(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = f"{folder}/shards"
    ordered.mapInArrow(write, SHARDS).write.parquet(manifest)
    found = {r["part"]: r for r in spark.read.schema(SHARDS).parquet(manifest).collect()}
    base = prefix_sums({part: r["ids"] for part, r in found.items()})
    listed = [(*found[part], base[part]) for part in sorted(found)]
    return spark.createDataFrame(listed, SHARDS + ", base long"), folder


def mapped(fs, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    import pyarrow.fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        import os

        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_ids(shards: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and its ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = store(r["folder"])
                side = mapped(fs, f"{path}/{r['name']}.idx", "u1")
                n = r["docs"]
                offsets, keys = (side[a:b].view("<i8") for a, b in ((0, 8 * n + 8), (8 * n + 8, 16 * n + 8)))
                nulls = side[16 * n + 8:].astype(bool)
                ids = mapped(fs, f"{path}/{r['name']}.bin", f"<u{r['width']}")
                first = 0
                while first < n:
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, "right")) - 1)
                    flat = ids[offsets[first]:offsets[last]].astype("<u4")
                    at = offsets[first:last + 1] - offsets[first]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[first:last], pa.int64(), mask=nulls[first:last]),
                        pa.array(offsets[first:last] + r["base"], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((4 * at).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())]),
                    ], ["doc_id", "start", "n_tokens", "ids"])
                    first = last

    return shards.repartition(parts_of(shards), "part").mapInArrow(read, ROWS)


def ids_at(shards: DataFrame, spark: SparkSession, start: int, length: int) -> np.ndarray:
    """The ids [start, start + length) of the whole corpus, from the mapped files."""
    out = []
    for r in shards.where((F.col("base") < start + length) & (F.col("base") + F.col("ids") > start)).orderBy("base").collect():
        fs, path = store(r["folder"])
        ids = mapped(fs, f"{path}/{r['name']}.bin", f"<u{r['width']}")
        out.append(np.asarray(ids[max(0, start - r["base"]):start + length - r["base"]], np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def crc_of(ids: np.ndarray) -> int:
    """The unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())

"""Web archives written with an index first, and read through it (operator 8).

Each task writes its records to archive files of about FILE_BYTES, one gzip
member per record, under names of its own, and reports one index row per
record: file, offset, length, url, digest. Spark commits the index as a table,
so records of a lost attempt are never read. A reader takes the index rows it
wants, sorts them by file and offset, and fetches neighbouring records with
one range read.

Of records with equal payloads of at least LEAST_SHARED bytes, the one with
the smallest page_id is the response, and the others are revisit records that
name it; smaller payloads are all responses. A null payload counts as empty,
a null url is the header `urn:page:<page_id>`. A null page_id is never
referred to: such a row is a revisit if any other row has its payload, else a
response. Rows that repeat the smallest page_id are all responses. An empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .common import blocks, own_name, parts_of, store

FILE_BYTES = 64 << 20
#: Payloads of so many bytes are kept once.
LEAST_SHARED = 100
#: A read goes on over a gap of this many bytes, and holds so many bytes at most unless a record is larger.
GAP, RANGE_BYTES = 64 << 10, 8 << 20

INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, ok boolean"


def record(kind: str, uri: str, identity: str, payload: bytes, digest: bytes, date: str, refers: str | None) -> bytes:
    """One record as a gzip member. A revisit has no block; its length and digest headers are the payload's own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{identity}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", "sha256:" + base64.b32encode(digest).decode()), ("X-Payload-Length", str(len(payload)))]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{refers}>")]
    block = b"" if refers is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and the payload of one record."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    block = raw[end + 4:end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4:] if block else b""


def identity(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}"))


def planned(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null: a response)."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256))
    small = rows.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "payload_digest")
    first = small.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only payloads that come again are joined; their pages are few, and a hot one is split by adaptive execution
    return rows.join(first, "payload_digest", "left").withColumn(
        "refers_to", F.when(F.coalesce(F.col("page_id") > F.col("refers_to"), F.col("refers_to").isNotNull()), F.col("refers_to")))


def write_warc(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row; returns the index, a table in the same folder."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        out, name, at = None, "", 0
        try:
            for block, texts in blocks(batches, 8_000_000, "html"):
                found = []
                for page, link, refers, text in zip(*(block.column(i).to_pylist() for i in range(3)), texts, strict=True):
                    payload = text.encode("utf-8", "surrogatepass")
                    digest = hashlib.sha256(payload)
                    name_of = identity(refers, digest.hexdigest()) if refers is not None else None
                    kind = "response" if refers is None else "revisit"
                    member = record(kind, link or f"urn:page:{page}", identity(page, digest.hexdigest()), payload, digest.digest(), date, name_of)
                    if out is None or at and at + len(member) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = own_name("records", ".warc.gz"), 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    found.append((page, link, f"{folder}/{name}", at, len(member), kind, len(payload), digest.hexdigest(), refers))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
                    pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                    [c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    planned(pages, key, url, html).select("page_id", "url", "refers_to", "html").mapInArrow(work, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_warc(index: DataFrame, parts: int | None = None) -> DataFrame:
    """The records of these index rows, read back; `ok` tells whether digest and length of the record agree with the index."""

    def ranges(rows: list[dict]) -> Iterator[list[dict]]:
        """Runs of rows of one file whose bytes are fetched together."""
        run: list[dict] = []
        for r in rows:
            if run and (r["file"] != run[0]["file"] or r["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP
                        or r["offset"] + r["length"] - run[0]["offset"] > RANGE_BYTES):
                yield run
                run = []
            run.append(r)
        if run:
            yield run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        try:
            for batch in batches:
                for run in ranges(batch.to_pylist()):
                    if run[0]["file"] != name:
                        if opened is not None:
                            opened.close()
                        name = run[0]["file"]
                        fs, path = store(name)
                        opened = fs.open_input_file(path)
                    start = run[0]["offset"]
                    data = opened.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                    out = []
                    for r in run:
                        head, payload = parsed(data[r["offset"] - start:r["offset"] - start + r["length"]])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha256:")).hex()
                        kind, size = head["warc-type"], int(head["x-payload-length"])
                        same = digest == r["payload_digest"] and size == r["payload_bytes"] and kind == r["record_type"]
                        refers = r["refers_to"] if kind == "revisit" else None
                        if kind == "response":
                            same &= hashlib.sha256(payload).hexdigest() == digest and len(payload) == size
                        else:
                            same &= head.get("warc-refers-to") == f"<urn:uuid:{identity(refers, digest)}>"
                        out.append((r["page_id"], r["url"], kind, refers, digest, size, payload, same))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()), strict=True)],
                        [c.split()[0] for c in RECORDS.split(", ")])
        finally:
            if opened is not None:
                opened.close()

    # neighbours stay together: a slice is a part of one file
    slices = F.floor(F.col("offset") / (4 * RANGE_BYTES))
    dealt = index.repartition(parts or parts_of(index), "file", slices).sortWithinPartitions("file", "offset")
    return dealt.select(*[c.split()[0] for c in INDEX.split(", ")]).mapInArrow(work, RECORDS)

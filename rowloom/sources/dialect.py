"""Guess the dialect of many delimited files at once, one row per file.

Small files are looked at as a whole. Of the others every line is read by tasks that hold one line at a time: whether the lines are
valid and which line ends there are is counted per block, and names and delimiter come from the first lines. Lines end at line
feeds or, where a file has too few of these, at carriage returns. What this does not decide is read as a whole as well: a file
with a very long line, or whose first records are very long, or that Spark would decompress.
"""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

# Candidate delimiters in order of preference, and the sample size.
CANDIDATES = (",", ";", "|", "\t")
SAMPLE_LINES = 5
RESULT = ("path string, encoding string, delimiter string, newline string, has_header boolean, "
          "headers array<string>, detected_columns int, confidence string, warnings array<string>")
UNSURE_DELIMITER = "The delimiter is a guess; check it if the rows look wrong."
NO_HEADER = "No clear header line; column names were generated."
EMPTY = "The file has no usable line."
#: Bytes: files up to this are read whole; lines from this on are not held; the beginning from which a sample is taken.
WHOLE_FILE, LONGEST_LINE, HEAD = 1_000_000, 8_000_000, 1_000_000
#: Names of files that Spark's text reader decompresses.
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
MARK = b"\xef\xbb\xbf"
SAMPLE = "file string, kind string, delimiter string, has_header boolean, headers array<string>, detected_columns int, confidence string, warnings array<string>"


def encoding_of_bytes(raw: bytes) -> str:
    if raw[:2] == b"\xff\xfe":
        return "utf-16le"
    if raw[:2] == b"\xfe\xff":
        return "utf-16be"
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for at in range(0, len(raw), HEAD):
            decoder.decode(raw[at:at + HEAD])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "windows-1252"
    return "utf-8"


def _parsed(text: str, delimiter: str, limit: int) -> tuple[list[list[str]], bool]:
    """The first records that are not blank, and whether text is left after them."""
    rows: list[list[str]] = []
    stream = io.StringIO(text, newline="")
    for record in csv.reader(stream, delimiter=delimiter, skipinitialspace=True):
        if any(cell.strip() for cell in record):
            rows.append(record)
            if len(rows) == limit:
                return rows, bool(stream.read(1))
    return rows, False


def _first_lines(text: str, limit: int) -> list[str]:
    lines: list[str] = []
    for line in io.StringIO(text):
        if line.strip():
            lines.append(line.strip())
            if len(lines) == limit:
                break
    return lines


def _delimiter(lines: list[str]) -> tuple[str, str]:
    """The candidate giving the most fields; among equals the most even one."""
    scored = []
    for candidate in CANDIDATES:
        widths = [len(next(csv.reader([line], delimiter=candidate), [])) for line in lines]
        scored.append((sum(widths), max(widths) - min(widths), candidate))
    score, spread, best = min(scored, key=lambda s: (-s[0], s[1]))
    if score >= 3 * len(lines) and spread <= 1:
        return best, "high"
    return best, "low" if score <= len(lines) else "medium"


def _wordy(cell: str) -> bool:
    return any("a" <= c <= "z" or c in "_ " for c in cell.strip().lower())


def _has_header(rows: list[list[str]]) -> bool:
    if len(rows) < 2:
        return True
    second = rows[1] + [""] * len(rows[0])
    words = sum(_wordy(a) and not _wordy(b) for a, b in zip(rows[0], second))
    return words >= max(len(rows[0]) // 2, 1)


def _sample(raw: bytes, encoding: str, whole: bool) -> tuple | None:
    """(delimiter, has_header, headers, detected_columns, confidence, warnings) of a file or, if `whole` is false, of its
    beginning; None if that is too short to tell."""
    text = raw.decode("cp1252" if encoding == "windows-1252" else encoding, errors="replace").lstrip("\ufeff")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not whole:
        text = text[:text.rfind("\n") + 1]
    lines = _first_lines(text, SAMPLE_LINES)
    if not whole and len(lines) < SAMPLE_LINES:
        return None
    if not lines:
        return ",", False, [], 0, "low", [EMPTY]
    delimiter, confidence = _delimiter(lines)
    rows, more = _parsed(text, delimiter, SAMPLE_LINES)
    if not whole and not more:
        return None
    width = max(len(r) for r in rows)
    header = _has_header(rows)
    names = [c.strip() for c in rows[0]] if header else []
    names = [(names[i] if i < len(names) else "") or f"column_{i + 1}" for i in range(width)]
    warnings = ([] if confidence == "high" else [UNSURE_DELIMITER]) + ([] if header else [NO_HEADER])
    return delimiter, header, names, width, confidence, warnings


def scan_bytes(path: str, raw: bytes) -> tuple:
    """Dialect of one file's content, as a row of RESULT."""
    encoding, size = encoding_of_bytes(raw), HEAD
    newline = "cr" if b"\r" in raw and b"\r\n" not in raw else "auto"
    while (found := _sample(raw[:size], encoding, size >= len(raw))) is None:
        size *= 8
    return path, encoding, found[0], newline, *found[1:]


def _samples(file: str, head: bytes) -> list[tuple]:
    """Rows of SAMPLE, from the beginning of a file, for what the whole of it may turn out to be; the text reader has taken a byte order mark of UTF-8 away."""
    utf_16 = {b"\xff\xfe": "utf-16le", b"\xfe\xff": "utf-16be"}.get(head[:2])
    kinds = [(utf_16, head)] if utf_16 else [("utf-8", head), ("windows-1252", head)]
    found = [(kind, _sample(raw, kind.removesuffix("+mark"), False)) for kind, raw in [*kinds, ("windows-1252+mark", MARK + head)]]
    return [(file, kind, *sample) for kind, sample in found if sample]


def _heads(lines: DataFrame, line_sep: str) -> DataFrame:
    """Rows of SAMPLE from the first block of each file; none of a file whose sample needs more."""
    sep, names = line_sep.encode(), [c.split()[0] for c in SAMPLE.split(", ")]
    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c, types[k]) for c, k in (f.split() for f in SAMPLE.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        file, head = None, bytearray()

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in _samples(file, bytes(head))], schema)

        for batch in batches:
            files, sizes, values, n = *batch.columns, batch.num_rows
            for at in range(n):
                here = files[at].as_py()
                if here != file:
                    if file is not None:
                        yield found()
                    file, head = here, bytearray()
                if len(head) < HEAD:
                    value = values[at].as_py()
                    head += value + sep if len(value) == sizes[at].as_py() else value
                elif files[n - 1].as_py() == file:
                    break
        if file is not None:
            yield found()

    return lines.where("start = 0").select("file", "n", F.expr(f"substring(bytes, 1, {HEAD})").alias("value")).mapInArrow(work, SAMPLE)


def _by_lines(text: DataFrame, files: DataFrame, line_sep: str) -> DataFrame:
    """RESULT and file of those of the files (path, file, length) of which the lines tell all."""
    plain = ~reduce(or_, [F.endswith(F.col("_metadata.file_path"), F.lit(c)) for c in COMPRESSED])
    lines = text.where((F.col("_metadata.file_size") > WHOLE_FILE) & plain).select(
        "value", F.col("value").cast("binary").alias("bytes"), F.octet_length("value").alias("n"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    at_edge = F.endswith("value", F.lit("\r")) if line_sep == "\n" else F.startswith("value", F.lit("\n"))
    blocks = lines.select("file", "start", "at", "n", F.is_valid_utf8("value").alias("valid"), F.contains("value", F.lit("\r")).alias("cr"),
                          at_edge.alias("edge")).groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("n") + 1).alias("bytes"), F.bool_and("valid").alias("valid"), F.bool_or("cr").alias("cr"),
        F.count_if("edge").alias("edges"), F.min_by("edge", "at").alias("first"), F.max_by("edge", "at").alias("last"))
    found = blocks.groupBy("file").agg(
        F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.bool_and("valid").alias("valid"), F.bool_or("cr").alias("cr"),
        F.sum("edges").alias("edges"), F.min_by("first", "start").alias("first"), F.max_by("last", "start").alias("last"))
    # every byte is in a line that was read: the lines and their ends make up the file, whose last line may have no end
    over = F.col("bytes") - F.col("length")
    marked, unended = over.isin(-len(MARK), 1 - len(MARK)), over.isin(1, 1 - len(MARK))
    if line_sep == "\n":
        pairs, any_cr = F.col("edges") - (unended & F.col("last")).cast("int"), F.col("cr")
    else:
        pairs, any_cr = F.col("edges") - F.col("first").cast("int"), ~(unended & (F.col("lines") == 1))
    kind = F.when(F.col("valid"), "utf-8").when(marked, "windows-1252+mark").otherwise("windows-1252")
    right = (F.col("kind") == kind) | (F.col("kind").startswith("utf-16") & ~marked)
    known = files.join(found, "file").where(over.isin(0, 1, -len(MARK), 1 - len(MARK))).join(_heads(lines, line_sep), "file").where(right)
    encoding = F.regexp_replace("kind", r"\+mark$", "").alias("encoding")
    newline = F.when(any_cr & (pairs == 0), "cr").otherwise("auto").alias("newline")
    return known.select("path", encoding, "delimiter", newline, "has_header", "headers", "detected_columns", "confidence", "warnings", "file")


def csv_scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Encoding, delimiter, line ends, header and column names of every file under `path`.

    Files of up to WHOLE_FILE bytes are looked at as a whole inside one task. Larger ones are read line by line by many tasks,
    when this is called; those that their lines do not settle are read as a whole after that.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def reader():
        return spark.read.option("pathGlobFilter", pattern) if pattern else spark.read

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            yield pd.DataFrame([scan_bytes(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=columns)

    def whole(which) -> DataFrame:
        return files.where(which).select("path", "content").mapInPandas(scan, RESULT)

    files = reader().format("binaryFile").load(path)
    large = files.where(F.col("length") > WHOLE_FILE).select("path", F.col("_metadata.file_path").alias("file"), "length")
    if large.isEmpty():
        return whole(F.lit(True))
    result, left = whole(F.col("length") <= WHOLE_FILE), None
    for line_sep in ("\n", "\r"):
        text = reader().option("lineSep", line_sep).option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_LINE).text(path)
        told = written(_by_lines(text if left is None else text.where(left), large, line_sep), "csv-dialects")
        result = result.unionByName(told.drop("file"))
        large = large.join(told.select("file"), "file", "left_anti")
        names = [r["file"] for r in large.select("file").collect()]
        if not names:
            return result
        left = F.col("_metadata.file_path").isin(names)
    return result.unionByName(whole(left))

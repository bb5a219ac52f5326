"""Delimited text: all columns are strings, short rows are padded."""

from __future__ import annotations

from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import names as name_list
from ..session import written
from .quoted import is_open, quoted_records

# Accepted spellings of delimiters and encodings.
DELIMITERS = {"": ",", "tab": "\t", "\\t": "\t", "\\\\t": "\t"}
ENCODINGS = {
    "": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8",
    "utf-16le": "UTF-16LE", "utf16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf16be": "UTF-16BE",
    "windows-1252": "windows-1252", "cp1252": "windows-1252", "win1252": "windows-1252",
    "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1",
}
#: Different first lines that the files of one read may have.
MOST_HEADERS = 100
BYTE_ORDER_MARK = "﻿"


def delimiter_of(text: str | None) -> str:
    """One character, or a name such as tab; anything else is a comma."""
    text = text or ""
    if text == "\t":
        return text
    text = text.strip()
    named = DELIMITERS.get(text.lower())
    if named:
        return named
    return text if len(text) == 1 else ","


def encoding_of(text: str | None) -> str:
    found = ENCODINGS.get((text or "").strip().lower())
    if found is None:
        raise ValueError(f"read_csv: unsupported encoding {text!r}")
    return found


def letter_names(n: int) -> list[str]:
    return [chr(ord("A") + i) for i in range(n)]


def _options(spark: SparkSession, delimiter, encoding, newline, lazy_quotes, trim_leading_space, multi_line) -> dict:
    charset = encoding_of(encoding)
    if charset == "windows-1252" and spark.conf.get("spark.sql.legacy.javaCharsets") != "true":
        raise ValueError("read_csv: windows-1252 needs spark.sql.legacy.javaCharsets=true, as rowloom.session sets it")
    options = {
        "sep": delimiter_of(delimiter), "encoding": charset, "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": str(trim_leading_space).lower(), "ignoreTrailingWhiteSpace": "false",
        "unescapedQuoteHandling": "STOP_AT_DELIMITER" if lazy_quotes else "RAISE_ERROR",
        "multiLine": str(multi_line).lower(), "comment": "", "maxCharsPerColumn": "-1",
    }
    if newline == "cr":
        options["lineSep"] = "\r"
    elif charset.startswith("UTF-16") and not multi_line:
        options["lineSep"] = "\n"
    return options


def _files(spark: SparkSession, path, options: dict, trim: bool) -> DataFrame:
    """(file, head, open): the first line of each file and whether a line leaves a quoted field open; one splittable pass, written."""
    lines = spark.read.options(**{k: v for k, v in options.items() if k == "lineSep"}).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("at"))
    head = F.when(F.col("start") == 0, F.regexp_replace("value", f"^{BYTE_ORDER_MARK}|\r$", ""))
    first = F.min_by(head, F.when(F.col("start") == 0, F.col("at")))
    return written(lines.groupBy("file").agg(first.alias("head"), F.max(is_open(F.col("value"), options["sep"], trim)).alias("open")), "csv-files")


def _heads(files: DataFrame) -> list[Row]:
    """(head, file, open): one row per different first line."""
    found = files.groupBy("head").agg(F.min("file").alias("file"), F.max("open").alias("open")).orderBy("head").limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ValueError(f"read_csv: more than {MOST_HEADERS} different first lines")
    return found


def _cells(spark: SparkSession, path, options: dict) -> list[str]:
    first = spark.read.options(**options, header="false").csv(path).limit(1).collect()
    return [c or "" for c in first[0]] if first else []


def _names(cells: list[str]) -> list[str]:
    return [c.replace(BYTE_ORDER_MARK, "").strip() or f"column_{i + 1}" for i, c in enumerate(cells)]


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str | None = ",", encoding: str = "utf-8",
             newline: str = "auto", has_header: bool = True, headers=None, skip_empty_lines: bool = False,
             lazy_quotes: bool = True, trim_leading_space: bool = True, fields_per_record: int = -1,
             blank_as: str = "empty", auto_names: str = "column", multi_line: bool | None = None, same_headers: bool = False) -> DataFrame:
    """Read delimited files.

    Names come from the first line, from `headers` (with has_header=False) or are
    generated: column_1.. or A, B, C.. with auto_names="letters". Missing and
    empty fields are "" or, with blank_as="null", NULL. `fields_per_record` of 0
    or more makes a row of another width an error.

    A first pass over the text finds the first lines of the files and whether some quoted field goes
    on in the next line. If one does, the records are assembled by
    all tasks (`quoted.py`), which costs one more pass. `multi_line` False says that no field does;
    True reads each file whole in one task, as Spark's own reader does, without a look.
    UTF-16 files, delimiters that are not ASCII, and files where lone carriage returns stand
    beside open fields are read whole as well.

    Files whose first lines differ are read by their own names; the names
    must be the same ones in any order, else this raises. With same_headers=True
    (all files are known to agree) the first lines are not compared. UTF-16
    files are not compared.
    """
    if not path:
        raise ValueError("read_csv: path is required")
    if newline not in ("auto", "cr", "lf", "crlf", ""):
        raise ValueError(f"read_csv: unknown newline {newline!r}")
    if blank_as not in ("empty", "null"):
        raise ValueError(f"read_csv: blank_as must be 'empty' or 'null', got {blank_as!r}")
    if auto_names not in ("column", "letters"):
        raise ValueError(f"read_csv: auto_names must be 'column' or 'letters', got {auto_names!r}")
    charset = encoding_of(encoding)
    options = _options(spark, delimiter, encoding, newline, lazy_quotes, trim_leading_space, bool(multi_line))
    plain = not charset.startswith("UTF-16") and ord(options["sep"]) < 128
    compared, heads = has_header and not same_headers, []
    if plain and (multi_line is None or compared):
        files = _files(spark, path, options, trim_leading_space)
        heads = _heads(files)
    split_records = multi_line is None and any(r["open"] for r in heads)
    if multi_line is None and (split_records or not plain):
        options = _options(spark, delimiter, encoding, newline, lazy_quotes, trim_leading_space, True)
    given = name_list(headers)
    if has_header or not given:
        cells = _cells(spark, path, options)
        if not cells:
            return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in given]))
    if has_header:
        columns = _names(cells)
    elif given:
        columns = given
    else:
        n = len(cells)
        columns = letter_names(n) if auto_names == "letters" else [f"column_{i + 1}" for i in range(n)]
    own = {}
    if compared and len(heads) > 1:
        own = {r["head"]: _names(_cells(spark, unquote(r["file"]), options)) for r in heads if r["head"] is not None}
    for other in own.values():
        if set(other) != set(columns):
            raise ValueError(f"read_csv: files with other columns: {columns} and {other}")
    strict = fields_per_record >= 0
    if fields_per_record > 0 and fields_per_record != len(columns):
        raise ValueError(f"read_csv: {len(columns)} columns, but fields_per_record={fields_per_record}")

    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    records = None
    if split_records:
        records = quoted_records(spark, path, options["sep"], trim_leading_space, options.get("lineSep", "\n"), has_header, charset)
    if records is not None:
        parse = {k: v for k, v in options.items() if k not in ("encoding", "multiLine", "lineSep")}
        parsed = F.from_csv("value", ", ".join(f"{n} string" for n in schema.names), {**parse, "mode": mode})
        df = records.where(F.trim("value") != "").select("file", parsed.alias("r")).select("file", "r.*")
    else:
        reader = spark.read.schema(schema).options(**options, header=str(has_header).lower(), enforceSchema="true", mode=mode)
        if strict:
            reader = reader.option("columnPruning", "false")
        df = reader.csv(path)
        if own:
            df = df.select(F.col("_metadata.file_path").alias("file"), *schema.names)
    if charset.startswith("UTF-16"):
        df = df.withColumn("_0", F.regexp_replace("_0", f"^{BYTE_ORDER_MARK}", ""))
        last = f"_{len(columns) - 1}"
        df = df.withColumn(last, F.regexp_replace(last, "\r$", ""))
    if skip_empty_lines:
        df = df.filter(reduce(or_, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in schema.names]))
    if blank_as == "empty":
        df = df.na.fill("")
    # Of columns with one name the last one counts.
    last_of = {name: i for i, name in enumerate(columns)}
    if not own:
        return df.select(*[F.col(f"_{i}").alias(name) for name, i in last_of.items()])
    # Each row takes its values by the names of its file: a number per order of names, one row per file.
    orders = list(dict.fromkeys(tuple(v) for v in own.values()))
    numbers = spark.createDataFrame([(head, orders.index(tuple(v))) for head, v in own.items()], "head string, names int")
    df = df.join(files.join(numbers, "head").select("file", "names"), "file")
    place = [{name: i for i, name in enumerate(o)} for o in orders]
    value = lambda name: F.coalesce(*[F.when(F.col("names") == k, F.col(f"_{p[name]}")) for k, p in enumerate(place)])
    return df.select(*[value(name).alias(name) for name in last_of])


def csv_preview(spark: SparkSession, path: str, limit: int = 20, **options) -> DataFrame:
    """The first `limit` rows of a file."""
    if limit < 1:
        raise ValueError(f"csv_preview: limit must be at least 1, got {limit}")
    options.setdefault("multi_line", True)  # only the beginning is read
    options.setdefault("same_headers", True)
    return read_csv(spark, path, **options).limit(limit)

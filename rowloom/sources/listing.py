"""Files of a folder as rows."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, path, extension, size and modifiedAt of the files directly under `path`.

    The content column of the reader is pruned, so no file is opened. Spark's
    scan leaves out files of size 0; they come from the reader's own file list,
    without a modification time.
    """
    if not path:
        raise ValueError("directory: path is required")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern or "*").load(path)
    listed = [(re.sub(r"^(\w+):///", r"\1:/", unquote(f)),) for f in files.inputFiles()]
    known = spark.createDataFrame(listed, T.StructType([T.StructField("path", T.StringType())]))
    seen = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modifiedAt"))
    empty = known.join(seen.select(F.col("path").alias("__seen")), F.col("path") == F.col("__seen"), "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("modifiedAt"))
    name = F.substring_index("path", "/", -1)
    return seen.unionByName(empty).select(
        name.alias("name"), "path", F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"), "size", "modifiedAt")

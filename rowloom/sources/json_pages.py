"""Rows out of stored JSON response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records(body: Column, schema: str | T.StructType, data_path: str | None = None, errors: str = "raise") -> Column:
    """The objects of a JSON body as an array of structs.

    An array gives its objects and drops its other items; one object gives one
    record; any other body, and a body that is cut off or no JSON, fails the
    job, or gives NULL with errors="null". So does a field whose value is not of the type that `schema` gives it: it fails
    the job, or is NULL. A NULL body gives NULL.
    """
    if errors not in ("raise", "null"):
        raise ValueError(f"json: errors must be 'raise' or 'null', got {errors!r}")
    text = F.get_json_object(body, f"$['{data_path}']") if data_path else F.trim(body)
    start = F.substring(F.ltrim(text), 1, 1)
    items = F.from_json(text, T.ArrayType(T.StringType()))
    objects = F.filter(items, lambda item: F.startswith(F.ltrim(item), F.lit("{")))
    wrong = F.raise_error(F.concat(F.lit("json body is not a whole array or object: "), F.left(body, F.lit(80)))).cast("array<string>")
    whole = F.when(start == "[", F.json_array_length(text).isNotNull()).when(start == "{", F.json_object_keys(text).isNotNull())
    texts = F.when(body.isNull(), None).when(F.coalesce(whole, F.lit(False)), F.when(start == "[", objects).otherwise(F.array(text)))
    texts = texts.otherwise(wrong if errors == "raise" else F.lit(None))
    mode = {"mode": "FAILFAST" if errors == "raise" else "PERMISSIVE"}
    return F.transform(texts, lambda item: F.from_json(item, schema, mode))


def explode_records(df: DataFrame, body: str, schema, data_path: str | None = None, keep=(), errors: str = "raise") -> DataFrame:
    """One row per record of the JSON text in column `body`; `keep` columns are repeated."""
    rows = df.select(*keep, F.explode(records(F.col(body), schema, data_path, errors)).alias("__record"))
    return rows.select(*keep, "__record.*")


def json_pages(spark: SparkSession, path: str, schema: str | T.StructType | None = None, data_path: str | None = None,
               page_size: int | None = None, page_pattern: str = r"(\d+)\D*$", max_pages: int | None = None,
               errors: str = "raise") -> DataFrame:
    """Records of a folder of stored responses, one whole file per response.

    With `page_size` the files are the pages of one request series: the number
    in the file path orders them and reading ends with the first page that is
    not full, as an offset client would stop; a file without a number fails the
    job. `max_pages` ends it sooner. Without `page_size` all files are read.
    Without a schema one is inferred from the data. `errors` is as for `records`.
    """
    if not path:
        raise ValueError("json_pages: path is required")
    pages = spark.read.text(path, wholetext=True).withColumn("__file", F.col("_metadata.file_path"))
    if schema is None:
        schema = _inferred(spark, path, data_path)
    pages = pages.withColumn("__records", records(F.col("value"), schema, data_path, errors))
    if page_size:
        number = F.regexp_extract("__file", page_pattern, 1).try_cast("bigint")
        unnumbered = F.raise_error(F.concat(F.lit("json_pages: no page number in "), F.col("__file"))).cast("bigint")
        pages = pages.withColumn("__page", F.coalesce(number, unnumbered))
        short = F.when(F.size("__records") < page_size, F.col("__page"))
        ends = pages.agg(F.struct(F.min("__page").alias("first"), F.min(short).alias("last")).alias("ends")).scalar()
        pages = pages.filter(F.col("__page") <= F.coalesce(ends.getField("last"), F.col("__page")))
        if max_pages is not None:
            pages = pages.filter(F.col("__page") < ends.getField("first") + max_pages)
    return pages.select(F.explode("__records").alias("__record")).select("__record.*")


def _inferred(spark: SparkSession, path: str, data_path: str | None) -> T.StructType:
    """The record schema, from Spark's own look at all bodies."""
    found = spark.read.json(path, multiLine=True).schema
    if data_path:
        kind = found[data_path].dataType
        found = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(found, T.StructType):
        raise ValueError(f"json_pages: {data_path or 'the body'} holds no objects")
    return found

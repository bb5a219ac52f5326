"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage reads what the one before it kept. All but the last return the
columns of `documents`. Documents of any shape pass: a null or empty text is
no language and goes with the first stage. Rows that share a doc_id are
different documents if their texts differ: each decision holds for one doc_id
and one text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm import exact, language, neardup, packing, secrets
from rowloom.session import delete_folder, scratch, written

#: Least share of the best language among the learned ones. A text of some words has nearly all of it, also in a language that was not learned.
LEAST_SCORE = 0.4


#: Encoded chunks that a worker keeps while it packs: few, as executors still hold memory of the stages before.
KEPT_CHUNKS = 100_000

#: Slots of the table that tells which rows a decision may concern: at least, at most, and for each such row.
LEAST_SLOTS, MOST_SLOTS, SLOTS_PER_ROW = 1 << 16, 1 << 25, 16


def _marks(decisions: Callable[[], DataFrame]) -> DataFrame:
    """(__id, __digest, __stays) of the documents that a stage drops or has several rows of; narrow, written, and all that stays of its scratch.

    `decisions` gives (doc_id, digest, stays) per row; of rows equal in doc_id and digest at most one stays.
    """
    with scratch() as made:
        rows = decisions().groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.max("stays").alias("__stays"), F.count("*").alias("n"))
        marks = written(rows.where("not __stays or n > 1").drop("n"), "marks")
        made.keep_last()
    return marks


def _apply(docs: DataFrame, digest: Column, marks: DataFrame) -> DataFrame:
    """The rows of `docs` that the marks leave: a decision holds for one doc_id and one text.

    A table of bits, whose size is bounded, says which rows no mark concerns; they pass without being moved.
    The others meet the marks in a join; where the marks are too many for the table, that is all rows.
    """
    n = marks.count()
    if not n:
        return docs
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_PER_ROW * n):
        slots *= 2
    bit = F.expr("shiftleft(1L, cast(__slot % 64 as int))")
    words = marks.withColumn("__slot", F.pmod(F.xxhash64("__id", "__digest"), F.lit(slots))).groupBy(F.expr("__slot div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    rows = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__text": digest})
    rows = rows.withColumn("__slot", F.pmod(F.xxhash64("__own", "__text"), F.lit(slots)))
    rows = rows.join(F.broadcast(words.withColumnRenamed("__word", "__w")), F.expr("__slot div 64 = __w"), "left")
    concerned = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    here = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest"))
    met = rows.where(concerned).join(marks, here, "left").where(F.coalesce("__stays", F.lit(True)))
    one = Window.partitionBy("__own", "__text").orderBy(F.xxhash64("text"), "text")
    met = met.withColumn("__n", F.row_number().over(one)).where(F.col("__stays").isNull() | (F.col("__n") == 1))
    return rows.where(~concerned).select(*docs.columns).unionByName(met.select(*docs.columns))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go: those without a letter, and those that no language of the corpus explains better than the others."""
    return language.accepted(docs, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; rows that repeat a document become one."""
    def decisions() -> DataFrame:
        return exact.exact_dedup(docs)[0].select("doc_id", F.unhex("text_sha256").alias("digest"), F.col("kept").alias("stays"))

    lowered = F.translate(_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _apply(docs, F.unhex(F.sha2(lowered, 256)), _marks(decisions))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, of several of its texts one."""
    def decisions() -> DataFrame:
        rows = written(neardup.near_dedup(docs).select("doc_id", "digest", "group"), "near-rows")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
        first = rows.where("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.min(order).alias("first"))
        mine = F.struct(F.col("doc_id").isNull(), "doc_id", "digest").eqNullSafe(F.col("first"))
        return rows.join(first, F.col("group") == F.col("g"), "left").select("doc_id", "digest", F.when(F.col("group").isNull(), True).otherwise(mine).alias("stays"))

    return _apply(docs, F.unhex(F.sha2(_text(), 256)), _marks(decisions))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the values of secrets are replaced, and n_chars counts the new text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, kept_chunks=KEPT_CHUNKS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


#: (name, function) in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Language scores, the field's spans and token ids are not SQL's to give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each stage's rows are written and read again, then its scratch and the rows before it are removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name)
            made.keep_last()
        for folder in before:
            delete_folder(folder)
        before = made.kept
    return docs

"""Each operator of the subpackage as a query on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import contract_sql, conversations, exact, html, idfiles, language, neardup, packing, pieces, quality, search, secrets, variants, warc


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled ids of every document, and the digests of its text and of what the ids decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _read(spark, folder, "documents")
    encoded = written(pieces.encode(docs, model), "pieces")  # else each task would hold an encoding and a decoding worker
    decoded = pieces.decode(encoded, model)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2("text", 256).alias("decoded_sha256"), "ids")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards, _ = idfiles.write_ids(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return idfiles.read_ids(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_read(spark, folder, "documents"))


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, folder, "documents"))[0]


def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_dedup(_read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(_read(spark, folder, "documents")).drop("text")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(_read(spark, folder, "pages")))
    good = F.assert_true("ok", "a record differs from its index row").isNull()
    return records.where(good).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_read(spark, folder, "pages"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", "step_group")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of six and more letters with five occurrences, after the damage by the contract; a null doc_id counts as an empty one."""
    found = variants.runs(_read(spark, folder, "documents"), least=6)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(h % 199 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 6)
    return variants.group_variants(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of `conversations` after the damage by the contract, by a hash of the conversation and the turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hit = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit")).where("hit != 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations")
    rows = damaged(turns)
    audits = written(conversations.audits(rows), "audits")
    hashes = conversations.digests(conversations.repaired(rows, audits), in_order=True)
    out = turns.select("conv_id").distinct()
    for part in (audits, hashes):
        out = out.join(part, F.col("conv_id").eqNullSafe(part["conv"]), "left").drop(part["conv"])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_top_k": op4_top_k,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality": op13_quality,
}

#: Lower-casing of A-Z alone, in SQL.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_top_k": """
        WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM t q JOIN t c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({LOWER}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)""",
    "op6_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
            list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
              FROM u a JOIN u b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (m + n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        k AS (SELECT a, min(b) AS k FROM r GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, k.k AS component_id, s.doc_id = k.k AS kept FROM s JOIN k ON s.doc_id = k.a""",
    "op8_warc": """
        WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM t)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
            CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM m""",
    "op11_spelling_variants": contract_sql.VARIANTS,
    "op12_conversation_repair": contract_sql.REPAIR,
}

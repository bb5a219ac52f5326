"""Exact top-k by inner product with MaxScore over posting lists (operator 4).

A vector is a set of terms: each component of a dimension is a posting in the
list of that dimension and sign, with its size as the impact. A query's term
in a list of its own sign raises a score by weight times impact, and its bound
is weight times the list's largest impact; lists of the other sign only lower
scores, and their bound is 0. With a threshold (the k-th score so far), the
terms whose bounds add up to less than it are non-essential: a row that is in
none of the essential lists cannot enter. The essential lists are traversed in
full; rows whose partial score plus the bound of the rest still competes are
probed for the rest exactly. The threshold rises from block to block of rows,
and lists are split anew.

Rows and queries are dealt to a grid of cells (row shard, query block), so
that neither side is ever held whole. A cell returns k rows per query; these
are merged. Ties go to the smaller id; a query's own row takes no part.

Null vectors and vectors that hold a null, NaN or infinite component take no
part; missing components of shorter vectors count 0. Rows without an id take
no part. An id that several rows share is compared as several rows. Scores
must fit 62 bits, else the search stops with an error. An empty table, or no
query, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block, about; rows whose lists a threshold holds for.
SHARD_ROWS, QUERY_ROWS, STEP_ROWS = 4096, 2048, 1024
#: Shards at least, so that small tables use all machines.
LEAST_SHARDS = 12

RESULT = "query_id long, vec_id long, score long"


class Lists:
    """The posting lists of some rows, kept by column: impacts by list (dimension and sign), and the lists' largest impacts."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.impacts = np.concatenate([np.maximum(vectors, 0), np.maximum(-vectors, 0)], 1).astype(np.float64)
        self.most = self.impacts.max(0) if len(vectors) else np.zeros(2 * vectors.shape[1])


def split(weights: np.ndarray, most: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Per query the essential lists (queries x lists). Those left out have bounds that add up to less than the threshold."""
    bounds = weights * most
    order = np.argsort(bounds, axis=1)
    below = np.cumsum(np.take_along_axis(bounds, order, 1), 1) < threshold[:, None]
    essential = np.empty_like(below)
    np.put_along_axis(essential, order, ~below, 1)
    return essential & (bounds > 0)


def top(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the k best rows of each query."""
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(queries):
        return none, none, none
    size = max(int(np.abs(rows).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * rows.shape[1]
    if size >= 1 << 62:
        raise ValueError("components too large: a score may pass 62 bits")
    # sums in 64-bit floats are exact below 2**53; beyond it the bounds are widened by more than the rounding
    slack = 0.0 if size < 1 << 53 else size * 2.0**-40
    plus = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], 1).astype(np.float64)  # weights of the lists of the same sign
    minus = np.concatenate([plus[:, rows.shape[1]:], plus[:, :rows.shape[1]]], 1)
    best_q, best_r, best_s = none, none, none
    threshold = np.full(len(queries), -np.inf)
    for first in range(0, len(rows), STEP_ROWS):
        part = slice(first, first + STEP_ROWS)
        lists = Lists(rows[part])
        essential = split(plus, lists.most, threshold - slack)
        rest = np.where(essential, 0, plus) @ lists.most
        partial = np.where(essential, plus, 0) @ lists.impacts.T
        competing = (partial + (rest + slack)[:, None] >= threshold[:, None]) & (query_ids[:, None] != ids[part][None])
        # no row of an essential list: the rest alone stays under the threshold
        q, r = np.nonzero(competing)
        # probe: first the lists that lower the score, then the exact sum of what is left
        for one in np.array_split(np.arange(len(q)), len(q) // 100_000 + 1):
            lowered = partial[q[one], r[one]] + rest[q[one]] - np.einsum("ij,ij->i", minus[q[one]], lists.impacts[r[one]])
            keep = one[lowered + slack >= threshold[q[one]]]
            score = np.einsum("ij,ij->i", queries[q[keep]], lists.vectors[r[keep]])
            best_q, best_r, best_s = (np.concatenate(x) for x in ((best_q, q[keep]), (best_r, r[keep] + first), (best_s, score)))
        order = np.lexsort((ids[best_r], -best_s, best_q))
        best_q, best_r, best_s = best_q[order], best_r[order], best_s[order]
        start = np.searchsorted(best_q, best_q, "left")
        kept = np.arange(len(best_q)) - start < k
        best_q, best_r, best_s = best_q[kept], best_r[kept], best_s[kept]
        many = np.bincount(best_q, minlength=len(queries))
        full = np.flatnonzero(many == k)
        threshold[full] = best_s[np.searchsorted(best_q, full, "right") - 1]
    return best_q, best_r, best_s


def scaled(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * component) of each usable row."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = x.isNotNull() & F.col(f"`{key}`").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(good).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` (over vec_id) selects, the k other rows of the largest inner product."""
    rows = scaled(vectors, key, vector, scale)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("d")).first()
    shards, parts, width = max(LEAST_SHARDS, -(-counts["n"] // SHARD_ROWS)), max(1, -(-counts["q"] // QUERY_ROWS)), counts["d"] or 0
    cell = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    mine = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    candidates = rows.select(mine(shards, "row").alias("shard"), cell("part", parts), "vec_id", "v")
    queries = rows.where(is_query).select(cell("shard", shards), mine(parts, "query").alias("part"), "vec_id", "v")

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["v"]):
            out[i, :len(v)] = v
        return out

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, query_ids = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        q, r, s = top(matrix(left), ids, matrix(right), query_ids, k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": s})

    found = candidates.groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

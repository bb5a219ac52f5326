"""Language of whole texts by prediction by partial matching (operator 3).

Each language has a tree of byte contexts of lengths 0 to `order`, with the
counts of the bytes that followed each. A byte that a context has seen `c`
times costs -log2(c / (n + q)) bits, n being all counts and q the distinct
bytes of the context; any other byte costs the escape, -log2(q / (n + q)), and
then what the next shorter context charges; below the empty context every
byte costs 8 bits. Contexts that a tree lacks are passed over without a
charge. The counts are frozen after fitting, so a text's code length in a
language is a sum over its positions, and the language of the shortest code
is the prediction. The score is that language's share of the probabilities
that all languages give to the text.

Null texts and texts without a letter get `und` and score 0, as do all texts
when there is nothing to learn from. Languages that tie go to the first by
name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, let_go

#: Longest context in bytes; at most 7.
ORDER = 3
#: Bound of the fit: rows of a language, taken by a hash of the id, and the number of languages.
FIT_ROWS, MOST_LANGUAGES = 300, 200
#: Sequences of ORDER + 1 bytes that a language's sample has more seldom leave no trace in its tree.
LEAST_COUNT = 2
#: Sampled texts of a language below which single occurrences are kept as well, so that a rare language has a tree.
FEW_ROWS = 20
UNKNOWN = "und"


def grams(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte of each position with the `order` bytes before it as one integer, and the number of positions of each text."""
    pad = b"\n" * order
    flat = np.frombuffer(pad + pad.join(data), np.uint8).astype(np.uint64)
    sizes = np.asarray([len(d) for d in data], np.int64)
    own = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for i in range(order):
        own[starts + i] = False
    key = np.zeros(len(flat), np.uint64)
    for back in range(order, -1, -1):
        key[order:] = key[order:] << np.uint64(8) | flat[order - back:len(flat) - back]
    return key[own], sizes


class Model:
    """Costs in bits for every context and byte of any language's tree, one column per language."""

    def __init__(self, languages: list[str], order: int, counts: list[dict[int, int]]) -> None:
        self.languages, self.order = languages, order
        self.entries: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        if not languages:
            return  # nothing learnt
        full = [(np.fromiter(c.keys(), np.uint64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in counts]
        for k in range(order + 1):
            seen = []
            for keys, n in full:
                low, at = np.unique(keys & self._mask(k + 1), return_inverse=True)
                seen.append((low, np.bincount(at, n, len(low))))
            entries = np.unique(np.concatenate([s[0] for s in seen]))
            contexts = np.unique(entries >> np.uint64(8))
            costs, escapes = (np.zeros((len(x), len(languages)), np.float32) for x in (entries, contexts))
            shorter = np.full((len(entries), 1), 8.0) if k == 0 else self.costs[-1][np.searchsorted(self.entries[-1], entries & self._mask(k))]
            of = np.searchsorted(contexts, entries >> np.uint64(8))
            for column, (keys, n) in enumerate(seen):
                at = np.searchsorted(entries, keys)
                total, distinct = np.bincount(of[at], n, len(contexts)), np.bincount(of[at], minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[:, column] = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0)
                costs[:, column] = escapes[of, column] + shorter[:, min(column, shorter.shape[1] - 1)]
                costs[at, column] = -np.log2(n / (total + distinct)[of[at]])
            self.entries.append(entries)
            self.contexts.append(contexts)
            self.costs.append(costs)
            self.escapes.append(escapes)

    @staticmethod
    def _mask(count: int) -> np.uint64:
        return np.uint64((1 << 8 * count) - 1)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        key, sizes = grams(texts, self.order)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for k in range(self.order, -1, -1):
            if not len(key):
                return out
            entries = self.entries[k]
            at = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
            hit = entries[at] == key
            self._add(out, owner[hit], self.costs[k][at[hit]])
            miss = ~hit
            key, owner = key[miss], owner[miss]
            contexts, context = self.contexts[k], key >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            self._add(out, owner[known], self.escapes[k][at[known]])
            key = key & self._mask(k)
        self._add(out, owner, np.full((len(owner), len(self.languages)), 8.0))
        return out

    @staticmethod
    def _add(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
        """Add rows of `values` to their owners, which are in ascending order."""
        if len(owner):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[starts]] += np.add.reduceat(values.astype(np.float64), starts, axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if usable and self.languages:
            bits = self.bits([texts[i].encode("utf-8", "surrogatepass") for i in usable])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i, b, s in zip(usable, best, share, strict=True):
                out[i], score[i] = self.languages[b], float(s)
        return out, score


def fit(labelled: DataFrame, order: int = ORDER, fit_rows: int = FIT_ROWS, least: int = LEAST_COUNT) -> Model:
    """Trees of the languages in (doc_id, text, lang), from at most `fit_rows` whole texts of each.

    The sample's ids are chosen first, without the texts; only counts reach the driver.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    if usable.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    order_by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("r", F.row_number().over(order_by)).where(F.col("r") <= fit_rows).select("doc_id", "lang")
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")  # at most fit_rows for each of MOST_LANGUAGES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found: Counter[int] = Counter()
                for text in texts:
                    key, n = np.unique(grams([text.encode("utf-8", "surrogatepass")], order)[0], return_counts=True)
                    found.update(dict(zip(key.view(np.int64).tolist(), n.tolist(), strict=True)))
                yield pd.DataFrame({"lang": lang, "gram": list(found.keys()), "n": list(found.values())})

    rows = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    trees: dict[str, dict[int, int]] = {}
    few = [r["lang"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") < FEW_ROWS).collect()]
    for r in rows.where((F.col("n") >= least) | F.col("lang").isin(few)).toLocalIterator():
        trees.setdefault(r["lang"], {})[r["gram"] & 0xFFFFFFFFFFFFFFFF] = r["n"]
    names = sorted(trees)
    return Model(names, order, [trees[n] for n in names])


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that the fit must not see."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    model = fit(rows.where(~held_out()), **options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for block, texts in blocks(batches, 1_000_000):
            found, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(found), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float, key: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> DataFrame:
    """The rows of `docs`, with all columns, whose text is in a language with a score of `least_score`; nothing is shuffled."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    model = fit(rows.where(~held_out()), **options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for block, texts in blocks(batches, 1_000_000, text):
            yield block.filter(pa.array([p != UNKNOWN and s >= least_score for p, s in zip(*model.predict(texts), strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

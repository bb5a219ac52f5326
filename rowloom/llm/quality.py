"""Quality of documents by a factorisation machine (operator 13).

A text's features are its words and its words' shapes (letters, digits and
signs in runs), both hashed, and statistics of its structure and its metadata,
cut in bins. Every feature has a weight and a short vector; the score is the
logistic function of the weights' sum plus all pairs' products of vectors. The
pairs are not visited: half of (square of the sum less sum of the squares), per
component of the vectors, is their total, so a text is scored in time linear in
its features.

The machine is fitted on the driver when the query runs, by Adam on at most
`fit_rows` labelled texts, half of each label at most, drawn by a hash of
their ids over the whole table and weighted back to the labels' true shares, so
that scores are probabilities. Only features reach the driver: at most
6 bytes for each of WORDS + SHAPES buckets per text. The model is sent to the tasks
and has the same size whatever the input. Labels, languages, sources and ids
are no inputs of a score.

Labels: null labels count for nothing; the mean of a document's labels decides
(a half counts as 1). A null id matches no label, an id without text rows is not drawn, texts
that share a labelled id all have its label, and repeated rows count once. Null texts are empty; empty and
blank texts get the score of their statistics. Without any usable label all
scores are 0.5. Texts of any length are read whole, every row gets one
result, an empty table gives an empty result. Columns other than the id,
the text and `n_chars` (where there is one) are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

#: Buckets of words and of shapes; bins of a statistic; components of a feature's vector.
WORDS, SHAPES, BINS, FACTORS = 4096, 1024, 12, 8
#: Labelled texts of the fit at most; passes over them, texts a step, step size, and the pull of weights towards 0.
FIT_ROWS, PASSES, BATCH, RATE, DECAY = 6000, 25, 64, 0.02, 1e-4
#: Score from which a document is predicted to be good.
LEAST_SCORE = 0.3
#: Distinct words and their bytes that a worker keeps; they change no result.
KEPT_WORDS, KEPT_BYTES = 300_000, 16_000_000

STATISTICS = ("characters", "words", "lines", "word_length", "longest_word", "letters", "digits", "blanks", "signs", "upper", "stops",
              "wordless", "signed_words", "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "top_line", "line_length",
              "given_characters", "given_differs")
FEATURES = "doc_id long, text_hash long, statistics array<float>, buckets binary, amounts binary"

LETTER_RUN, DIGIT_RUN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
SIGNED = re.compile(rb"[a-z0-9\x80-\xff][^a-z0-9\x80-\xff]{2,}\Z")
_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LETTERS = UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
DIGITS = (_BYTE >= 48) & (_BYTE <= 57)
BLANKS = (_BYTE == 32) | (_BYTE >= 9) & (_BYTE <= 13)
STOPS = np.isin(_BYTE, [33, 46, 63])


class Words(dict):
    """Word -> row of `facts`: word bucket, shape bucket, length, without a letter, ends with signs."""

    def __init__(self) -> None:
        super().__init__()
        self.facts, self.bytes = np.zeros((1024, 5), np.int64), 0

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        shape = DIGIT_RUN.sub(b"0", LETTER_RUN.sub(b"a", word))
        self.facts[at] = (xxhash.xxh3_64_intdigest(word) % WORDS, WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES, len(word),
                          b"a" not in shape, SIGNED.search(word[-64:]) is not None)
        self.bytes += len(word)
        self[word] = at
        return at


_words = Words()


def features(text: str, given: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The statistics of a text, and the buckets of its words and shapes with their amounts (each kind of length 1)."""
    global _words
    if len(_words) > KEPT_WORDS or _words.bytes > KEPT_BYTES:
        _words = Words()
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    found = raw.lower().split()
    ids = np.fromiter(map(_words.__getitem__, found), np.int64, len(found))
    distinct, many = np.unique(ids, return_counts=True)
    facts, n = _words.facts[distinct], max(1, len(ids))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    line_counts: dict[bytes, int] = {}
    for line in lines:
        line_counts[line] = line_counts.get(line, 0) + 1
    pairs = len(np.unique(ids[:-1] * (len(_words) + 1) + ids[1:])) / (n - 1) if n > 1 else 1.0
    statistics = np.array([
        np.log1p(len(text)), np.log1p(len(ids)), np.log1p(len(lines)), (facts[:, 2] * many).sum() / n, np.log1p(facts[:, 2].max(initial=0)),
        counts[LETTERS].sum() / size, counts[DIGITS].sum() / size, counts[BLANKS].sum() / size,
        1 - counts[LETTERS | DIGITS | BLANKS].sum() / size, counts[UPPER].sum() / max(1, counts[LETTERS].sum()), counts[STOPS].sum() / n,
        (facts[:, 3] * many).sum() / n, (facts[:, 4] * many).sum() / n, len(distinct) / n, pairs, many.max(initial=0) / n,
        len(line_counts) / max(1, len(lines)), max(line_counts.values(), default=0) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))),
        -1.0 if given is None else np.log1p(max(0.0, given)), -1.0 if given is None else float(given != len(text))], np.float32)
    amounts = np.bincount(facts[:, 0], many, WORDS + SHAPES) + np.bincount(facts[:, 1], many, WORDS + SHAPES)
    buckets = np.flatnonzero(amounts)
    amounts = np.log1p(amounts[buckets])
    for kind in (buckets < WORDS, buckets >= WORDS):
        amounts[kind] /= max(1e-9, np.sqrt((amounts[kind] ** 2).sum()))
    return statistics, buckets, amounts.astype(np.float32)


@dataclass
class Machine:
    """bias, a weight and a vector of every feature, and the edges of the statistics' bins."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    edges: np.ndarray

    def row(self, statistics: np.ndarray, buckets: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All features of a text: places and values; a statistic has one of its bins."""
        bins = (self.edges < statistics[:, None]).sum(1)
        places = WORDS + SHAPES + np.arange(len(statistics)) * BINS + bins
        return np.concatenate([buckets, places]), np.concatenate([amounts, np.full(len(places), 1 / np.sqrt(len(places)), np.float32)])

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        weighted = self.vectors[places] * values[:, None]
        pairs = 0.5 * ((weighted.sum(0) ** 2).sum() - (weighted ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[places] @ values + pairs, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, seed: int = 13) -> Machine:
    """Fit a machine to features, labels (0 or 1) and the rows' weights (mean 1)."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(np.stack([r[0] for r in rows]), np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    size = WORDS + SHAPES + len(STATISTICS) * BINS
    machine = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), edges)
    sparse = [machine.row(*r) for r in rows]
    share = float(np.clip((labels * shares).mean(), 1e-3, 1 - 1e-3))
    theta = [np.array(np.log(share / (1 - share)), np.float32), machine.weights, machine.vectors]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for one in range(PASSES):
        rate = RATE * (1 - one / PASSES)
        for at in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH)):
            x = np.zeros((len(at), size), np.float32)
            for i, k in enumerate(at):
                x[i, sparse[k][0]] = sparse[k][1]
            sums, squares = x @ theta[2], x * x
            z = theta[0] + x @ theta[1] + 0.5 * ((sums ** 2).sum(1) - squares @ (theta[2] ** 2).sum(1))
            error = (shares[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / len(at)).astype(np.float32)
            slopes = [error.sum(), x.T @ error + DECAY * theta[1], x.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * theta[2] + DECAY * theta[2]]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope ** 2
                theta[i] = theta[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(float(theta[0]), theta[1].astype(np.float32), theta[2].astype(np.float32), edges)


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows whose labels the fit must not see; a null id is one of them."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % 5 == 0


def _rows(docs: DataFrame, key: str, text: str, given: str) -> DataFrame:
    number = F.col(f"`{given}`").cast("double") if given in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), number.alias("given"))


def featured(rows: DataFrame) -> DataFrame:
    """The features of (doc_id, text, given, text_hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in blocks(batches, 500_000):
            found = [features(t, g) for t, g in zip(texts, block.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                block.column(0), block.column(3), pa.array([f[0].tolist() for f in found], pa.list_(pa.float32())),
                pa.array([f[1].astype("<u2").tobytes() for f in found]), pa.array([f[2].astype("<f4").tobytes() for f in found])],
                ["doc_id", "text_hash", "statistics", "buckets", "amounts"])

    return rows.select("doc_id", "text", "given", "text_hash").mapInArrow(work, FEATURES)


def fit(rows: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine | None:
    """The machine of rows (doc_id, text, given) and labels (doc_id, label), held-out ids excluded; None without labels."""
    marks = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    hashed = rows.where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    usable = hashed.select("doc_id", "text_hash").distinct().join(marks, "doc_id")
    total = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total:
        return None
    drawn = [usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash").limit(fit_rows // 2) for label in total]
    keys = pd.concat([d.toPandas() for d in drawn], ignore_index=True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType())])
    table = rows.sparkSession.createDataFrame(keys[["doc_id", "text_hash"]], schema)
    found = featured(hashed.join(F.broadcast(table), ["doc_id", "text_hash"])).groupBy("doc_id", "text_hash").agg(
        *[F.min(c).alias(c) for c in ("statistics", "buckets", "amounts")])
    sample = found.toPandas().merge(keys, on=["doc_id", "text_hash"]).sort_values(["doc_id", "text_hash"])
    data = [(np.asarray(s, np.float32), np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(a, "<f4"))
            for s, b, a in zip(sample["statistics"], sample["buckets"], sample["amounts"], strict=True)]
    label = sample["label"].to_numpy(np.float32)
    shares = np.array([total[int(x)] / (label == x).sum() for x in label], np.float32)
    return train(data, label, shares / shares.mean())


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", given: str = "n_chars", label_key: str = "doc_id",
          label: str = "quality", least: float = LEAST_SCORE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    rows = _rows(docs, key, text, given)
    machine = fit(rows, labels.select(F.col(f"`{label_key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label")), fit_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in blocks(batches, 500_000):
            found = [0.5 if machine is None else machine.score(*machine.row(*features(t, g))) for t, g in zip(texts, block.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(3), pa.array(found, pa.float64()), pa.array([int(s >= least) for s in found], pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", held_out()).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")

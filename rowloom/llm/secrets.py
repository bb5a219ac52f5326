"""Secrets in whole texts: fixed rules and a linear-chain conditional random field (operator 7).

The rules find `assign`, `access` and `hex` secrets. The field tags the blank
separated tokens of a text as begin (B), inside (I) or outside (O) of a secret
from the token's shape, the words around it and the whole text's look; tokens
tagged B or I that no rule covers are spans of the kind `field`. It is fitted
to the rules' own finds in a bounded sample and to windows in which made-up
secrets of other shapes and wordings take their place, or stand in texts
without a find.

Decoding is Viterbi's. A token whose O outscores B and I by more than two
transitions can ever be worth is O in every best tagging; only the runs of
tokens between such ones are decoded step by step.

Null and empty texts have no spans. Repeated rows are each answered. The sample
has texts with finds of the rules from the whole table, and made-up secrets are
put into its other texts, so that every table has a field. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, let_go, text_of

# The kinds in their order, their patterns, and the least length of a match (of group 2 for assign).
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among all runs
LEAST = {"assign": 6, "access": 20}
#: Every match of ASSIGN has one of these in lower case.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The rules for Spark, least lengths included; a match within another one that is too short is found as well.
FINDS = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")

#: Sample: texts with and without the look of a secret, windows of a text, tokens to each side of a window's centre.
FIT_ROWS, WINDOWS, SIDE = 300, 3, 10
ROUNDS, RATE, DECAY = 80, 0.1, 1e-3
#: Bound of a transition's weight, so that few tokens need decoding.
MOST = 4.0
KEPT_TOKENS, LONG_TOKEN = 400_000, 200
B, I, O = 0, 1, 2  # noqa: E741
#: Sizes of the index ranges of the features, in the order of `own` and `around`.
OWN_SIZES, AROUND_SIZES = (12, 64, 6, 8, 5, 16, 16 * 12), (16, 16, 16, 8)
KEYWORD = re.compile("passw|secret|token|api_?key|credential|auth|pwd|private", re.IGNORECASE)
EDGES = "\"'`,;.!?()[]{}<>"
#: Made-up secrets that take the place of found ones in further windows of the fit: alphabets, lengths, and what stands before.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789",
             "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")
BEFORE = ("pwd=", "auth_key: ", "credential ", "private_key = ", "Authorization: Bearer ", "api-token ", "client_secret: \"", "secret is ")
VARIANTS = 3


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the rules' finds, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def own(token: str) -> tuple[int, ...]:
    """Indices of a token's own features, and last its class as a neighbour."""
    core = token.strip(EDGES)
    if core.isalpha():
        size, value = min(11, int(2 * math.log2(len(core) + 1))), core
        mask, share, entropy, changes = (not core.isupper()) | (not core.islower()) << 1 | core.isascii() << 5, 0, 0, 0
    else:
        value = re.split("[=:]", core)[-1].strip(EDGES) if core[:1] not in "=:" else core
        size = min(11, int(2 * math.log2(len(value) + 1)))
        mask = (any(map(str.islower, value)) | any(map(str.isupper, value)) << 1 | any(map(str.isdigit, value)) << 2
                | any(c in "+/_=-" for c in value) << 3 | any(not c.isalnum() for c in value) << 4 | value.isascii() << 5)
        share = min(5, 6 * sum(map(str.isdigit, value)) // max(1, len(value)))
        counts = Counter(value)
        total = sum(counts.values()) or 1
        entropy = min(7, int(2 * -sum(n / total * math.log2(n / total) for n in counts.values())))
        changes = min(4, len(re.findall(r"\d+|[^\W\d_]+", value)) // 2)
    around = (KEYWORD.search(token) is not None) | ("=" in token or ":" in token) << 1 | (token[-1:] in "=:") << 2 | (core != token) << 3
    return (size, mask, share, entropy, changes, around, size * 16 + around, around)


class Tokens(dict):
    """Token -> number of its tuple of features; the tuples are few, the tokens many."""

    def __init__(self) -> None:
        super().__init__()
        self.kinds: dict[tuple[int, ...], int] = {}
        self.table: list[tuple[int, ...]] = []

    def __missing__(self, token: str) -> int:
        features = own(token)
        if features not in self.kinds:
            self.kinds[features] = len(self.table)
            self.table.append(features)
        if len(token) <= LONG_TOKEN:
            self[token] = self.kinds[features]
        return self.kinds[features]


def look(text: str) -> int:
    """The whole text's class: signs of code or settings, signs of addresses, and digits."""
    return ("{" in text or ";" in text) | ("://" in text or "@" in text) << 1 | (text.count("=") * 200 > len(text)) << 2


def neighbours(near: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The classes of the last, the last but one and the next token; 0 beyond the text's ends."""
    out = []
    for step in (-1, -2, 1):
        other = np.zeros_like(near)
        (other[-step:] if step < 0 else other[:-step])[:] = near[:step] if step < 0 else near[step:]
        for back in range(abs(step)):
            edge = bounds[:-1] + back if step < 0 else bounds[1:] - 1 - back
            edge = edge[(edge >= 0) & (edge < len(near))]
            other[edge] = 0
        out.append(other)
    return out


#: The one feature of the tokens that fill up a short text's window; they are outside.
PADDING = sum(OWN_SIZES + AROUND_SIZES)
OFFSETS = np.concatenate([[0], np.cumsum(OWN_SIZES + AROUND_SIZES)[:-1]])


def features(numbers: np.ndarray, table: np.ndarray, looks: int) -> np.ndarray:
    """Feature indices (tokens x features) of one text."""
    base = table[numbers]
    around = neighbours(base[:, -1].copy(), np.asarray([0, len(numbers)]))
    return np.concatenate([base[:, :-1], np.stack(around, 1), np.full((len(base), 1), looks)], 1) + OFFSETS


class Field:
    """Weights (features x 3) and transitions (3 x 3, from row to column); a text starts and ends outside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.sure = 2 * float(moves.max() - moves.min())

    @classmethod
    def fitted(cls, index: np.ndarray, labels: np.ndarray) -> Field:
        """Penalised likelihood of windows of equal length (windows x tokens x features; windows x tokens), by Adam."""
        size = PADDING + 1
        many, length = labels.shape
        rows = np.arange(many)
        params = np.zeros(size * 3 + 9)
        mean, square = np.zeros_like(params), np.zeros_like(params)
        truth = np.zeros((many, length, 3))
        truth[rows[:, None], np.arange(length), labels] = 1
        path = np.concatenate([np.full((many, 1), O), labels, np.full((many, 1), O)], 1)
        taken = np.bincount((path[:, :-1] * 3 + path[:, 1:]).ravel(), minlength=9).reshape(3, 3)
        for step in range(1, ROUNDS + 1):
            weights, moves = params[:-9].reshape(size, 3), params[-9:].reshape(3, 3)
            scores = weights[index].sum(2)
            forward, backward = np.empty_like(scores), np.empty_like(scores)
            state = moves[O] + scores[:, 0]
            forward[:, 0] = state
            for t in range(1, length):
                state = np.logaddexp.reduce(state[:, :, None] + moves, axis=1) + scores[:, t]
                forward[:, t] = state
            state = np.broadcast_to(moves[:, O], (many, 3))
            backward[:, -1] = state
            for t in range(length - 2, -1, -1):
                state = np.logaddexp.reduce(moves + (scores[:, t + 1] + state)[:, None, :], axis=2)
                backward[:, t] = state
            whole = np.logaddexp.reduce(forward[:, -1] + moves[:, O], axis=1)
            share = np.exp(forward + backward - whole[:, None, None])
            pairs = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - whole[:, None, None, None]).sum((0, 1))
            pairs[O] += share[:, 0].sum(0)
            pairs[:, O] += share[:, -1].sum(0)
            gradient = np.zeros_like(params)
            flat = (share - truth).reshape(-1, 3)
            for k in range(3):
                gradient[k:-9:3] = np.bincount(index.reshape(-1), np.repeat(flat[:, k], index.shape[2]), size)
            gradient[-9:] = (pairs - taken).ravel()
            gradient = gradient / many + DECAY * params
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            params[-9:] = np.clip(params[-9:], -MOST, MOST)
        return cls(params[:-9].reshape(size, 3)[:PADDING], params[-9:].reshape(3, 3))

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of one run of tokens between outside ones."""
        state, back = self.moves[O] + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            options = state[:, None] + self.moves
            back[t] = options.argmax(0)
            state = options.max(0) + scores[t]
        tags = np.empty(len(scores), np.int64)
        tags[-1] = int((state + self.moves[:, O]).argmax())
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def tag(self, numbers: np.ndarray, table: np.ndarray, bounds: np.ndarray, looks: np.ndarray) -> np.ndarray:
        """The tags of texts laid end to end; the weights are summed for each kind of token and of neighbourhood first."""
        many = len(OWN_SIZES)
        alone = self.weights[table[:, :-1] + OFFSETS[:many]].sum(1).astype(np.float32)
        each = [self.weights[OFFSETS[many + k]:OFFSETS[many + k] + 16] for k in range(3)]
        near = (each[0][:, None, None] + each[1][None, :, None] + each[2][None, None]).reshape(-1, 3).astype(np.float32)
        last, before, following = neighbours(table[:, -1].astype(np.int16)[numbers], bounds)
        scores = alone[numbers] + near[(last << 8) + (before << 4) + following]
        scores += np.repeat(self.weights[OFFSETS[-1]:][looks].astype(np.float32), np.diff(bounds), axis=0)
        tags = np.full(len(scores), O, np.int64)
        open_ = np.flatnonzero(scores[:, O] - scores[:, :2].max(1) <= self.sure + 1e-3)
        if len(open_):
            text = np.searchsorted(bounds, open_, "right")
            cuts = np.flatnonzero((np.diff(open_) != 1) | (np.diff(text) != 0)) + 1
            for run in np.split(open_, cuts):
                tags[run] = self.decode(scores[run].astype(np.float64))
        return tags


def _variant(text: str, spans: list[tuple[int, int, int, int]], draw: random.Random) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with other secrets in other words at the rules' finds."""
    out, at, found, size = [], 0, [], 0
    for start, _, end, _ in spans:
        if start < at:
            continue
        secret = "".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(14, 48)))
        before = draw.choice(BEFORE)
        parts = [text[at:start], before]
        size += sum(map(len, parts))
        found.append((size - len(before), 3, size + len(secret), size))
        out += [*parts, secret, '"' * before.endswith('"')]
        size += len(secret) + before.endswith('"')
        at = end
    return "".join([*out, text[at:]]), found


def _planted(text: str, draw: random.Random) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with a made-up secret before one of its tokens, or at its end."""
    at = draw.choice([*(m.start() for m in re.finditer(r"\S+", text)), len(text)])
    return _variant(f"{text[:at]} {text[at:]}" if at < len(text) else f"{text} ", [(at + (at == len(text)), 3, at + (at == len(text)), at)], draw)


def _labels(text: str, spans: list[tuple[int, int, int, int]]) -> tuple[list[str], np.ndarray]:
    """The tokens of a text, and their tags by these spans."""
    where = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    tags = np.full(len(where), O, np.int64)
    starts = np.asarray([s for s, _ in where], np.int64)
    for _, _, end, value in spans:
        first, last = int(np.searchsorted(starts, value, "right")) - 1, int(np.searchsorted(starts, end, "left"))
        if first >= 0 and tags[first] == O:
            tags[first:last] = I
            tags[first] = B
    return [text[a:b] for a, b in where], tags


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Field | None:
    """A field from at most 2 * fit_rows different (doc_id, text), by a hash of both, half of them with finds; windows of tokens reach the driver.

    None for an empty table only.
    """
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("pick"), "text")
    picks = keyed.groupBy("pick").agg(F.max(F.col("text").rlike(FINDS)).alias("found"))
    first = picks.where("found").orderBy("pick").limit(fit_rows).union(picks.orderBy("pick").limit(fit_rows)).select("pick").distinct()
    sample = keyed.join(F.broadcast(first), "pick")
    many = len(OWN_SIZES) + len(AROUND_SIZES)
    span = 2 * SIDE + 1

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held, seen = Tokens(), set()
        for batch in batches:
            found = []
            for pick, text in zip(batch["pick"], batch["text"], strict=True):
                if pick in seen:  # a repeated row
                    continue
                seen.add(pick)
                spans = base_spans(text)
                draw = random.Random(len(text))
                more = [_variant(text, spans, draw) for _ in range(VARIANTS)] if spans else [_planted(text, draw)]
                for turn, (one, at_) in enumerate([(text, spans), *more]):
                    tokens, tags = _labels(one, at_)
                    if not tokens:
                        continue
                    marked = np.flatnonzero(tags == B)[:WINDOWS].tolist()
                    even = np.linspace(0, len(tokens) - 1, WINDOWS, dtype=int).tolist()
                    numbers = np.asarray([held[t] for t in tokens], np.int64)
                    index = features(numbers, np.asarray(held.table, np.int64), look(one))
                    if len(tokens) <= span:  # one window, filled up
                        index = np.concatenate([index, np.full((span - len(tokens), many), PADDING)])
                        tags = np.concatenate([tags, np.full(span - len(tokens), O)])
                        found.append((pick, turn, 0, index.ravel().tolist(), tags.tolist()))
                        continue
                    for place, centre in enumerate([*marked, *even]):
                        at = np.arange(centre - SIDE, centre + SIDE + 1)
                        at = at - min(0, at[0]) - max(0, at[-1] - len(tokens) + 1)
                        found.append((pick, turn, place, index[at].ravel().tolist(), tags[at].tolist()))
            yield pd.DataFrame(found, columns=["pick", "turn", "place", "f", "t"])

    got = sample.mapInPandas(windows, "pick long, turn int, place int, f array<int>, t array<int>").dropDuplicates(["pick", "turn", "place"]).toPandas()
    if not len(got):
        return None
    got = got.sort_values("f", key=lambda c: c.map(tuple)).reset_index(drop=True)  # the sum's order must not depend on the tasks
    index = np.stack([np.asarray(f, np.int64).reshape(span, many) for f in got["f"]])
    labels = np.stack([np.asarray(t, np.int64) for t in got["t"]])
    return Field.fitted(index, labels)


def spans_of(texts: list[str], field: Field | None, held: Tokens) -> list[list[tuple[int, int, int, int]]]:
    """(start, kind, end, start of the value) for each text: the rules' finds, and the field's that no rule covers."""
    out = [base_spans(t) for t in texts]
    if field is None:
        return out
    if len(held) > KEPT_TOKENS:
        held.clear()
    numbers: list[int] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        numbers.extend(map(held.__getitem__, text.split()))
        bounds[i + 1] = len(numbers)
    if not numbers:
        return out
    looks = np.asarray([look(t) for t in texts], np.int64)
    tags = field.tag(np.asarray(numbers, np.int64), np.asarray(held.table, np.int64), bounds, looks)
    marked = np.flatnonzero(tags != O)
    for i in np.unique(np.searchsorted(bounds, marked, "right") - 1):
        where = [(m.start(), m.end()) for m in re.finditer(r"\S+", texts[i])]
        rules, added = out[i], []
        for t in range(int(bounds[i]), int(bounds[i + 1])):
            if tags[t] == O:
                continue
            start, end = where[t - int(bounds[i])]
            inner = texts[i][start:end].strip(EDGES)
            start = start + texts[i][start:end].find(inner)
            end = start + len(inner)
            if inner and not any(s < end and e > start for s, _, e, _ in rules):
                if added and tags[t] == I and tags[t - 1] != O and t > bounds[i]:
                    added[-1] = (added[-1][0], 3, end, added[-1][3])
                else:
                    added.append((start, 3, end, start))
        out[i] = sorted([*rules, *added])
    return out


def described(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[secret]") -> str:
    """The text with the value of every span replaced."""
    out, at = [], 0
    for value, end in sorted((v, e) for _, _, e, v in spans):
        if end <= at:
            continue
        if value >= at:
            out += [text[at:value], mark]
        at = end
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, text string"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the text with the secrets replaced (`text`)."""
    rows = text_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    field = fit(rows, fit_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = Tokens()
        for block, texts in blocks(batches, 2_000_000):
            found = spans_of(texts, field, held)
            base = [[s for s in f if s[1] < 3] for f in found]
            yield pa.RecordBatch.from_arrays([
                block.column(0), *(pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(described(f).encode()).hexdigest() for f in base]), pa.array([described(f) for f in found], pa.string()),
                pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(work, SCHEMA)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", fit_rows: int = FIT_ROWS) -> DataFrame:
    """All rows and columns of `docs`, with the values of secrets replaced in `text`; `length`, if there is such a column, counts the new text."""
    field = fit(text_of(docs, key, text), fit_rows)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = Tokens()
        for block, texts in blocks(batches, 2_000_000, text):
            found = spans_of([t or "" for t in texts], field, held)
            changed = [i for i, f in enumerate(found) if f]
            if changed:
                columns = dict(zip(names, block.columns, strict=True))
                for i in changed:
                    texts[i] = redacted(texts[i], found[i])
                columns[text] = pa.array(texts, columns[text].type)
                if length in columns:
                    sizes = columns[length].to_pylist()
                    for i in changed:
                        sizes[i] = None if sizes[i] is None else len(texts[i])
                    columns[length] = pa.array(sizes, columns[length].type)
                block = pa.RecordBatch.from_arrays(list(columns.values()), names=names)
            yield block

    return docs.mapInArrow(work, docs.schema)

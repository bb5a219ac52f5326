"""Sampled SentencePiece segmentations, and decoding without loss (operator 1).

A text is a lattice: its positions are nodes, and every vocabulary piece that
matches between two positions is an edge. Forward filtering sums the weights
of all paths to each node; backward sampling starts at the end and draws each
piece in proportion to its weight times the sum at its start, so that whole
segmentations come with the probability of their weight. The draws come from
a counter-based generator keyed by the row's key, the place of the unit in the
text and the step, so a row has the same segmentation wherever and whenever
it is encoded.

A piece weighs exp(alpha * log p). A unigram model's scores are log p; a BPE
model's scores are minus the rank of its merges, for which log p follows
Zipf's law, -log(rank + 1). A character without a piece is spelt by its byte
pieces. No piece of the model goes on from a visible character to a blank, so
the lattice falls apart into units (blanks, then visible characters) that are
sampled apart; equal units share one lattice.

As in the model, a blank is written U+2581 and a text gets one in front; a
U+2581 in the text itself is spelt in bytes, so decoding gives back the text
exactly. Null stays null, the empty text has no pieces. Repeated rows have
equal segmentations. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, ragged

#: Share of a piece's log-probability in the sampling; 0 draws all segmentations alike, larger values the likely ones.
ALPHA = 1.0
#: log p of a character that is spelt in bytes.
SPELT = -25.0
#: Characters of a block, and units that are sampled at once.
BLOCK_CHARS, BLOCK_UNITS = 600_000, 100_000
#: Edges of units that a worker keeps from block to block; later ones are forgotten after their block. It changes no result.
KEPT_EDGES = 3_000_000
#: Ids that are decoded at once, besides a row that has more by itself.
DECODED_IDS = 300_000
UNIT = re.compile(r" *[^ ]+| +")
#: Finer units, where no piece joins a letter to a mark after it, or a line break to anything.
LETTER = r"[^\W\d_²]"
FINE_UNIT = re.compile(rf" *{LETTER}++(?=[,. \n]|\Z)| *[^ \n]+|\n| +")
JOINS = re.compile(rf"{LETTER}[,.]|.\n|\n.", re.DOTALL)
MARK = "▁"
#: Keeps units apart where they are searched together: no piece has it.
GAP = "\U0010ffff"
ENCODED = "doc_id long, ids array<int>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_loaded: dict[tuple[str, float], Lattice] = {}


class Numbers(dict):
    """Unit -> its number in order of appearance."""

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        return found


class Bytes:
    """The bytes of a model's pieces, which is all that decoding needs."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = [b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else
                 bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
                 for i in range(model.get_piece_size())]
        self.bytes_of = parts
        self.byte_length = np.asarray([len(b) for b in parts], np.int64)
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.first = np.cumsum(self.byte_length) - self.byte_length

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids laid end to end."""
        widths = self.byte_length[ids]
        flat = self.flat[ragged(self.first[ids], widths)].tobytes()
        sums = np.concatenate([[0], np.cumsum(widths)])
        ends = np.cumsum(counts)
        return [flat[a + 1:b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(sums[ends - counts], sums[ends], strict=True)]


class Lattice(Bytes):
    """The pieces of a model, their weights, and the byte pieces."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        scores = np.asarray([model.get_score(i) for i in range(self.size)])
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        ranked = bool((scores[plain] <= 0).all() and (scores[plain] == np.round(scores[plain])).all())
        self.weight = alpha * (-np.log1p(-np.minimum(scores, 0)) if ranked else scores)
        self.spelt = alpha * SPELT
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
        self.automaton: dict[str, int] = {}  # the pieces that `matches` finds
        self.length = np.ones(self.size, np.int64)
        inner = joins = False
        for i in plain:
            text = model.id_to_piece(i).replace(MARK, " ")
            if not text:
                continue
            self.length[i] = len(text)
            self.automaton[text] = i
            inner |= " " in text.lstrip(" ")
            joins |= JOINS.search(text) is not None
        self._grow(self.automaton)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot spell every text")
        self.numbers = Numbers()
        self.start, self.piece = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.running = np.zeros(1 << 16)
        self.first_node, self.last_node = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.edges_used = self.nodes_used = 0
        self.unit = re.compile(r"(?s).+") if inner else UNIT if joins else FINE_UNIT

    def _grow(self, pieces: dict[str, int]) -> None:
        """The trie of the pieces: a number for each of their characters, and sorted keys (node, character) of the nodes below."""
        letters = sorted(set().union(*pieces) - {GAP})
        self.letter = np.zeros(0x110001, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        nodes: dict[str, int] = {"": 0}
        keys: list[int] = []
        last: dict[int, int] = {}
        number = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        for text, i in pieces.items():
            if GAP in text:
                continue
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    keys.append(nodes[text[:n - 1]] * self.letters + number[text[n - 1]])
                    nodes[text[:n]] = len(nodes)
            last[nodes[text]] = i
        order = np.argsort(np.asarray(keys, np.int64))
        self.keys, self.below = np.asarray(keys, np.int64)[order], order + 1
        self.piece_at = np.full(len(nodes), -1, np.int64)
        self.piece_at[list(last)] = list(last.values())
        self.roots = np.zeros(self.letters, np.int64)  # 0: none
        first = self.keys < self.letters
        self.roots[self.keys[first]] = self.below[first]

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """End and piece of every match of a piece in a text: all places go down the trie together."""
        letter = np.append(self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], 0).astype(np.int64)
        node = self.roots[letter]
        at = np.flatnonzero(node)
        node = node[at]
        ends, pieces = [], []
        while len(at):
            at = at + 1
            piece = self.piece_at[node]
            found = np.flatnonzero(piece >= 0)
            ends.append(at[found])
            pieces.append(piece[found])
            key = node * self.letters + letter[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = np.flatnonzero(self.keys[place] == key)
            at, node = at[on], self.below[place[on]]
        return (np.concatenate(ends), np.concatenate(pieces)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the units' lattices, sorted by end; nodes of all units are numbered through, unit after unit.

        Returns start node, end node, piece (size + code point: a spelt
        character), first node of each unit, and last node of each unit.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        node = np.cumsum(sizes + 1) - sizes - 1
        # a unit of n characters and a gap take n + 1 places, as its nodes do
        end, piece = self.matches(GAP.join(units))
        start = end - self.length[piece]
        total = int(node[-1] + sizes[-1] + 1)
        single = np.zeros(total, bool)
        single[start[self.length[piece] == 1]] = True
        last = np.zeros(total, bool)
        last[node + sizes] = True
        bare = np.flatnonzero(~single & ~last)
        if len(bare):
            owner = np.searchsorted(node, bare, "right") - 1
            points = np.asarray([ord(units[u][p]) for u, p in zip(owner, bare - node[owner], strict=True)], np.int64)
            start, end, piece = np.concatenate([start, bare]), np.concatenate([end, bare + 1]), np.concatenate([piece, self.size + points])
        order = np.argsort(end * (int(self.length.max()) + 1) + start - end)  # of edges with one end the longest first
        return start[order], end[order], piece[order], node, node + sizes

    def forward(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering. Returns per edge start, piece and the running share among the edges into its end node plus the number of that
        node; and per unit its first and last node."""
        start, end, piece, first, last = self.edges(units)
        weight = np.where(piece < self.size, self.weight[np.minimum(piece, self.size - 1)], self.spelt)
        total = np.full(int(last[-1]) + 1, -np.inf)
        total[first] = 0
        owner = np.searchsorted(first, end, "right") - 1
        depth = end - first[owner]
        order = np.argsort(depth, kind="stable")  # within a depth still by end
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = order[a:b]
            value = total[start[e]] + weight[e]
            ends = end[e]
            heads = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            total[ends[heads]] = np.logaddexp.reduceat(value, heads)
        share = np.exp(total[start] + weight - total[end])
        running = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(end)))
        before = np.repeat(running[heads] - share[heads], sizes)
        whole = np.repeat(running[heads + sizes - 1] - (running[heads] - share[heads]), sizes)
        return start, piece, end + (running - before) / whole, first, last

    def learn(self, known: int, units: list[str]) -> int:
        """Append the lattices of units to the tables, after the first `known` units; the tables' new length in edges."""
        start, piece, running, first, last = self.forward(units)
        edges, many = self.edges_used + len(start), known + len(units)
        while edges > len(self.start):
            self.start, self.piece, self.running = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.piece, self.running))
        while many > len(self.first_node):
            self.first_node, self.last_node = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first_node, self.last_node))
        part = slice(self.edges_used, edges)
        self.start[part], self.piece[part], self.running[part] = start + self.nodes_used, piece, running + self.nodes_used
        self.first_node[known:many], self.last_node[known:many] = first + self.nodes_used, last + self.nodes_used
        return edges

    def sample(self, units: np.ndarray, seeds: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of occurrences of units (numbers into the tables), one 64-bit seed each: pieces in order, and their number."""
        start, piece, running, first, last = tables
        at, stop = last[units], first[units]
        active = np.argsort(units, kind="stable")  # so that neighbours look in one part of the tables
        active = active[at[active] > stop[active]]
        who, what = [], []
        step = 0
        while len(active):
            with np.errstate(over="ignore"):
                draw = (mix64(seeds[active] + np.uint64(step) * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            here = at[active]
            # running shares of node n lie in (n, n + 1], up to rounding, which the draw stays clear of
            edge = np.searchsorted(running, here + draw * (1 - 1e-7), "right")
            who.append(active)
            what.append(piece[edge])
            at[active] = start[edge]
            active = active[at[active] > stop[active]]
            step += 1
        counts = np.zeros(len(units), np.int64)
        for w in who:
            counts[w] += 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (w, p) in enumerate(zip(who, what, strict=True)):
            out[ends[w] - 1 - k] = p
        return out, counts

    def spell(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spelt characters as byte pieces."""
        spelt = np.flatnonzero(pieces >= self.size)
        if not len(spelt):
            return pieces, counts
        text = [chr(p - self.size).encode("utf-8", "surrogatepass") for p in pieces[spelt]]
        widths = np.ones(len(pieces), np.int64)
        widths[spelt] = [len(t) for t in text]
        ends = np.cumsum(widths)
        out = np.repeat(pieces, widths)
        out[ragged(ends[spelt] - widths[spelt], widths[spelt])] = self.byte_id[np.frombuffer(b"".join(text), np.uint8)]
        sums = np.concatenate([[0], ends])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(sums[edge])

    def encode(self, texts: list[str], keys: list[object], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts one after the other, and the number of ids of each."""
        cut: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.unit.findall(" " + text)
                cut.extend(found)
                counts[i] = len(found)
        if not cut:
            return np.zeros(0, np.int64), counts
        known = len(self.numbers)
        units = np.fromiter(map(self.numbers.__getitem__, cut), np.int64, len(cut))
        added = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        used = self.learn(known, added) if added else self.edges_used
        tables = (self.start, self.piece, self.running[:used], self.first_node, self.last_node)
        base = np.asarray([xxhash.xxh3_64_intdigest(f"{seed}:{k}".encode()) for k in keys], np.uint64)
        ends = np.cumsum(counts)
        place = np.arange(len(units)) - np.repeat(ends - counts, counts)
        with np.errstate(over="ignore"):
            seeds = mix64(np.repeat(base, counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        parts = [self.spell(*self.sample(units[a:a + BLOCK_UNITS], seeds[a:a + BLOCK_UNITS], tables)) for a in range(0, len(units), BLOCK_UNITS)]
        if used > KEPT_EDGES:
            for unit in added:
                del self.numbers[unit]
        elif added:
            self.edges_used, self.nodes_used = used, int(self.last_node[len(self.numbers) - 1]) + 1
        ids, per_unit = (np.concatenate([p[k] for p in parts]) for k in range(2))
        sums = np.concatenate([[0], np.cumsum(per_unit)])
        return ids, sums[ends] - sums[ends - counts]


def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattice(path, alpha)
    return _loaded[path, alpha]


def _lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(null, False)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id and sampled ids of every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattice(model, alpha)
        for block, texts in blocks(batches, BLOCK_CHARS):
            ids, counts = table.encode(texts, block.column(0).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([block.column(0), _lists(ids, counts, np.asarray([t is None for t in texts]))], ["doc_id", "ids"])

    return rows.mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids) with the text that the ids spell, as column `text`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bytes(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0)).astype(np.int64))
            first = 0
            while first < len(sums):
                done = int(sums[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(sums, done + DECODED_IDS, "right")))
                part = batch.slice(first, last - first)
                ids = part.column(1)
                counts = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
                texts = table.decode(np.asarray(ids.flatten()).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))],
                                                 ["doc_id", "ids", "text"])
                first = last

    return encoded.select("doc_id", "ids").mapInArrow(work, ENCODED + ", text string")

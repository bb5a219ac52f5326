"""Token ids of whole texts with a public tokenizer file.

A tokenizer of the byte-level or word-end BPE kind never joins characters
over the point where a visible character meets a blank, nor a letter with the
marks that end a word, so a text's ids are those of its chunks in order. Each
distinct chunk is encoded once and kept while it is among the most used; the
ids of a text are gathered from that table. Texts with unusual blanks are
encoded in one piece.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from .common import hold, ragged

#: Chunks that a worker keeps from block to block; beyond that, the most used half stays. It changes no result.
KEPT_CHUNKS = 400_000
#: Missing chunks that are encoded at once, as the tokenizer's answers are far larger than the ids, and characters whose ids are gathered at once.
BATCH_CHUNKS, BATCH_CHARS = 4096, 1_000_000
#: Missing chunks that are encoded as one text, where each id shows whether a chunk begins with it.
LINE_CHUNKS = 128
#: Texts of about so many characters are encoded at once.
BLOCK_CHARS = 3_000_000
#: Blanks that Python and a tokenizer's pattern may see differently.
ODD_BLANK = re.compile(r"[^\S \n]")
#: Runs of blanks, in which the cut before a chunk would not be the tokenizer's own.
RUNS = ("  ", " \n", "\n ", "\n\n")
#: Marks after a word's last letter that are chunks by themselves.
ENDS = ",.;:!?)]}\"%&$#*"
#: Marks a chunk that no blank precedes.
BARE = "\x02"
ODD = -1

_loaded: dict[str, Chunked] = {}


def ends_in_letter(text: str) -> bool:
    """Also once a tokenizer has normalised it: some letters become a letter and a mark, which goes with the marks that follow."""
    last = text[-1:]
    return last.isalpha() and (last.isascii() or unicodedata.normalize("NFC", last).lower()[-1].isalpha())


class Chunked(dict):
    """Chunk -> its number in a growing flat table of ids."""

    def __init__(self, path: str, kept: int | None = None) -> None:
        super().__init__()
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = self.whole("Ab Zq").tolist() == self.whole("ab zq").tolist()
        #: Blanks leave no ids, so they need no place in a chunk.
        self.blankless = self.whole(" a \n b ").tolist() == [*self.whole("a"), *self.whole("b")]
        #: The ids that begin with a blank or line break; in a text of chunks that all begin so, these are the chunks' first ids.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token[:1] in ("Ġ", "Ċ") and i < len(self.opens)]] = True
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)
        self.used = self.number = 0
        self._begin()

    def whole(self, text: str) -> np.ndarray:
        """The tokenizer's own answer for one text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _begin(self) -> None:
        self.waiting: list[str] = []
        self.waiting_at: list[int] = []
        self.joined: list[tuple[int, int, int]] = []

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha():
            here = self.number + len(self.waiting) + len(self.joined)
            self.waiting.append(chunk if self.blankless else " " + chunk)
            self.waiting_at.append(here)
        elif not self.blankless and (ODD_BLANK.search(chunk) or BARE in chunk[1:]):
            here = ODD
        elif (word := chunk.rstrip(ENDS)) != chunk and len(word) > 1 and ends_in_letter(word):
            head, tail = self[word], self[chunk[len(word):] if self.blankless else BARE + chunk[len(word):]]
            here = self.number + len(self.waiting) + len(self.joined)
            self.joined.append((here, head, tail))
        else:
            here = self.number + len(self.waiting) + len(self.joined)
            self.waiting.append(chunk if self.blankless or chunk[:1] == "\n" else chunk[1:] if chunk[:1] == BARE else " " + chunk)
            self.waiting_at.append(here)
        self[chunk] = here
        return here

    def _room(self, ids: int) -> None:
        while self.number + len(self.waiting) + len(self.joined) > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses))
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and the number of ids of each."""
        if not self.blankless and all(chunk[:1] in (" ", "\n") for chunk in chunks):
            lines = [chunks[at:at + LINE_CHUNKS] for at in range(0, len(chunks), LINE_CHUNKS)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(["".join(line) for line in lines], add_special_tokens=False)]
            if all(found):
                flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
                opens = self.opens[flat]
                starts = np.cumsum([0, *map(len, found[:-1])])
                if opens[starts].all() and np.add.reduceat(opens, starts, dtype=np.int64).tolist() == list(map(len, lines)):
                    return flat, np.diff(np.append(np.flatnonzero(opens), len(flat)))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _fill(self) -> int:
        """Encode what is missing; the table's new length in ids."""
        used = self.used
        waiting, places = self.waiting, self.waiting_at
        if not self.blankless:  # those without a blank in front last
            bare = [chunk[:1] not in (" ", "\n") for chunk in waiting]
            order = sorted(range(len(waiting)), key=bare.__getitem__)
            waiting, places = [waiting[i] for i in order], [places[i] for i in order]
            cuts = [*range(0, len(order) - sum(bare), BATCH_CHUNKS), *range(len(order) - sum(bare), len(order), BATCH_CHUNKS), len(order)]
        else:
            cuts = [*range(0, len(waiting), BATCH_CHUNKS), len(waiting)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            flat, lengths = self._ids(waiting[at:end])
            self._room(used + len(flat))
            self.flat[used:used + len(flat)] = flat
            here = places[at:end]
            self.start[here], self.length[here] = used + np.cumsum(lengths) - lengths, lengths
            used += len(flat)
        if self.joined:
            self._room(used)
            here, head, tail = np.asarray(self.joined, np.int64).T
            starts = np.stack([self.start[head], self.start[tail]], 1).ravel()
            parts = np.stack([self.length[head], self.length[tail]], 1)
            flat = self.flat[ragged(starts, parts.ravel())]
            lengths = parts.sum(1)
            self._room(used + len(flat))
            self.flat[used:used + len(flat)] = flat
            self.start[here], self.length[here] = used + np.cumsum(lengths) - lengths, lengths
            used += len(flat)
        return used

    def _chunks(self, text: str) -> list[str] | None:
        """None: the text has to be encoded in one piece."""
        if self.lowers and "<|" not in text and (text.isascii() or "Σ" not in text and unicodedata.is_normalized("NFC", text)):
            text = text.lower()
        if self.blankless:
            return text.replace("\n", " ").split(" ")
        if text[:1] in " \n" or text[-1] in " \n" or any(x in text for x in RUNS):
            return None
        return (BARE + text.replace("\n", " \n")).split(" ")

    def _forget(self) -> None:
        """Keep the most used half, of equally used ones the newest; earlier uses count half from here on."""
        kept = np.sort(np.argsort(self.uses[:self.number], kind="stable")[::-1][:(self.kept or KEPT_CHUNKS) // 2])
        place = np.full(self.number, ODD, np.int64)
        place[kept] = np.arange(len(kept))
        numbers = place.tolist()
        stay = {chunk: numbers[n] for chunk, n in self.items() if n != ODD and numbers[n] != ODD}
        self.clear()
        self.update(stay)
        lengths = self.length[kept]
        flat = self.flat[ragged(self.start[kept], lengths)]
        uses = self.uses[kept] // 2
        self.number, self.used = len(kept), len(flat)
        self.uses[:] = 0
        self.flat[:self.used], self.length[:self.number], self.uses[:self.number] = flat, lengths, uses
        self.start[:self.number] = np.cumsum(lengths) - lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        cuts, size = [0], 0
        for i, text in enumerate(texts):
            if i > cuts[-1] and size + len(text) > BATCH_CHARS:
                cuts.append(i)
                size = 0
            size += len(text)
        found = [self._encode(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        alone: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            chunks = self._chunks(text)
            if chunks is None:
                alone[i] = self.whole(text)
                continue
            numbers.extend(map(self.__getitem__, chunks))
            counts[i] = len(chunks)
        used = self._fill()
        at = np.asarray(numbers, np.int64)
        ends = np.cumsum(counts)
        if not self.blankless and (odd := at == ODD).any():
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")):
                alone[int(i)] = self.whole(texts[i])
        lengths = self.length[at]
        ids = self.flat[ragged(self.start[at], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        first, last = sums[ends - counts], sums[ends]
        self.number, self.used = self.number + len(self.waiting) + len(self.joined), used
        self._begin()
        self.uses[:self.number] += np.bincount(at[at != ODD], minlength=self.number)
        if len(self) > (self.kept or KEPT_CHUNKS):
            self._forget()
        if not alone:
            return ids, last - first
        parts = [alone[i] if i in alone else ids[a:b] for i, (a, b) in enumerate(zip(first, last, strict=True))]
        return np.concatenate(parts), np.asarray([len(p) for p in parts], np.int64)


def encoder(path: str, kept: int | None = None) -> Chunked:
    """The worker's table for one tokenizer file; `kept`: instead of KEPT_CHUNKS."""
    hold("tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Chunked(path)
    _loaded[path].kept = kept
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

"""Main text of web pages by a recurrent labeller of blocks (operator 9).

A page is cut into its leaf blocks: the runs of text between block-level tags
and line breaks. Each block has a vector of its tag path (tags, and the words
of class, id and role, hashed), of its words (hashed) and of a few counts. A
bidirectional LSTM in numpy reads the blocks of a page in order, so that each
decision sees the whole page, and the blocks that it marks are the text.

It is fitted on a bounded sample of the pages of any length, marked by their own
structure (`teacher`), of long ones on blocks from the start, the middle and
the end, and on further pages made by putting the sample's texts into
layouts of other names, so that it knows sidebars, notices, forms and reader
comments even where the sample has none. Where the sample has no mark at all,
the made-up pages alone are the fit, so that the labeller always decides.

Null and empty pages have an empty text, as do pages whose blocks are all
boilerplate. Unclosed tags and broken markup are read as far as they go: only
an unclosed script, style or textarea ends the page.
Repeated rows are each answered. An empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Pages of the fit; made-up pages for each; blocks of a page in the fit, and the characters of each that reach the driver.
FIT_PAGES, MADE_UP, FIT_BLOCKS, FIT_CHARS = 250, 3, 80, 4_000
#: Texts of 1 to 60 words for made-up pages where the sample has no marked ones.
STOCK = [((), " ".join("a line of this text says more than the next one and so it goes on with words".split()[(i + k * k) % 17] for k in range(1 + i * i // 15)) + end, 0)
         for i in range(30) for end in ("", ".")]
PATHS, WORDS, COUNTS, HIDDEN = 2048, 64, 6, 16
#: Words weigh less than paths by this divisor: a wording is seldom the mark of a block.
WORD_SHARE = 4
ROUNDS, RATE, FALL, BATCH = 16, 0.015, 0.85, 48

BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol option p pre section select summary table tbody td
tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that an opening tag of the same kind closes.
ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose content is no text of the page; those of which an unclosed one runs to the page's end.
SILENT = "script|style|textarea|template|svg|iframe|title"
TO_END = frozenset(("script", "style", "textarea"))
#: A tag as nearly all are written, with nothing in it that could begin another; others are read by `Tags`.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*)(?=[\s/>])((?:[^>"'<]|"[^"<>]*"|'[^'<>]*')*+)>""")
NAME_END, SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in SILENT.split("|")}
#: Names of a path that are kept: the outermost half and the innermost one.
PATH_NAMES = 512
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: Names by which the teacher tells boilerplate and content, as words of tags, classes, ids and roles.
OTHER = frozenset("""nav menu menubar navbar navigation header masthead banner footer aside sidebar complementary ad ads advert advertisement adverts sponsor
sponsored promo cookie cookies consent notice notices alert newsletter subscribe form search login share social related recommended
comment comments disqus respond replies breadcrumb breadcrumbs pagination button select dialog popup modal copyright contentinfo""".split())
MAIN = frozenset("article main post entry story content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Tags:
    """Ends of the odd tags of a page. What was looked for once is not looked for again, so a page is read in linear time."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.near = {NAME_END: -1, SPECIAL: -1}
        self.lost: set[int] = set()  # quotes from which no end is reached

    def _next(self, kind: re.Pattern, here: int) -> int:
        """The next place of a kind from `here` on, which grows from call to call; the page's length if there is none."""
        if self.near[kind] < here:
            m = kind.search(self.page, here)
            self.near[kind] = m.start() if m else len(self.page)
        return self.near[kind]

    def end(self, here: int) -> int:
        """The `>` that ends a tag whose attributes begin at `here`, outside their quotes, or -1."""
        at, seen = self._next(SPECIAL, here), []
        while at < len(self.page):
            quote = self.page[at]
            if quote == ">":
                return at
            if at in self.lost or at >= self.last[quote]:
                break
            seen.append(at)
            m = SPECIAL.search(self.page, self.page.index(quote, at + 1) + 1)
            at = m.start() if m else len(self.page)
        self.lost.update(seen)
        return -1

    def read(self, here: int) -> tuple[int, str, str, str, bool]:
        """(end, slash, name, attributes, whether it is a tag) of what begins with the `<` at `here`."""
        page, slash = self.page, "/" if self.page.startswith("</", here) else ""
        first = here + 1 + len(slash)
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            return (end + 3 if end >= 0 else len(page)), "", "", "", False
        if first < len(page) and page[first].isascii() and page[first].isalpha():
            after = self._next(NAME_END, first)
            end = self.end(after) if after < len(page) else -1
            if end < 0 and not slash and after - first < 10 and page[first:after].lower() in ENDS and self.last[">"] >= after:
                end = page.index(">", after)
            if end >= 0:
                return end + 1, slash, page[first:after], page[after:end], True
        if page[here + 1:here + 2] in ("!", "?", "/") and self.last[">"] > here:
            return page.index(">", here + 2) + 1 if self.last[">"] >= here + 2 else here + 1, "", "", "", False
        return here + 1, "", "", "<", False


def longer(path: tuple[str, ...], names: list[str]) -> tuple[str, ...]:
    """A path with the further names that it lacks."""
    for name in names:
        if name not in path:
            path = (*path, name) if len(path) < PATH_NAMES else (*path[:PATH_NAMES // 2], *path[PATH_NAMES // 2 + 1:], name)
    return path


def leaves(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(different names of the tag path, text, characters inside links) of every block that has text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # tag, path, place of the block-level element that it is or lies in
    counts: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    tags = Tags(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(markup.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(at: int) -> None:
        for tag, _, _ in stack[at:]:
            counts[tag] -= 1
        del stack[at:]

    here = 0
    unclosed: set[str] = set()  # silent tags that are closed nowhere in the rest of the page
    while here < len(page):
        start = page.find("<", here)
        if start != here:  # text up to the next tag
            text, here = page[here:start if start >= 0 else len(page)], start if start >= 0 else len(page)
            parts.append(text)
            linked += len(text) if counts.get("a") else 0
            continue
        m = TAG.match(page, here)
        if m:
            end, is_tag, (slash, tag, attributes) = m.end(), True, m.groups()
        else:
            end, slash, tag, attributes, is_tag = tags.read(here)
        closed = page[end - 2:end] == "/>"
        here = end
        if not is_tag:
            if attributes:  # a bare <
                parts.append(attributes)
                linked += 1 if counts.get("a") else 0
            continue
        tag = tag.lower()
        if not slash and tag in ENDS:
            if tag in BLOCK_TAGS:
                flush()
            if tag not in unclosed and (tag in TO_END or not closed):
                close = ENDS[tag].search(page, here) if tags.last[">"] >= here else None
                if close:
                    here = close.end()
                elif tag in TO_END:
                    here = len(page)
                else:  # read on after the tag
                    unclosed.add(tag)
            continue
        if tag in BLOCK_TAGS:
            flush()
        if slash:
            if counts.get(tag):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                cut(at)
            continue
        shut = ALONE.get(tag)
        if shut and stack:  # also through inline tags that were left open
            at, low = stack[-1][2], None
            while at >= 0 and stack[at][0] in shut:
                low, at = at, stack[at - 1][2] if at else -1
            if low is not None:
                cut(low)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            names = [w for g in NAMES.findall(attributes) for w in re.split(r"[\s_\-]+", "".join(g).lower()) if w]
            block_at = len(stack) if tag in BLOCK_TAGS else stack[-1][2] if stack else -1
            stack.append((tag, longer(stack[-1][1] if stack else (), [tag, *names]), block_at))
            counts[tag] = counts.get(tag, 0) + 1
    flush()
    return out


def teacher(found: list[tuple[tuple[str, ...], str, int]]) -> list[bool]:
    """Marks by structure: inside content and not inside boilerplate; without content tags, from the first to the last long text with few links."""
    named = any(MAIN.intersection(path) for path, _, _ in found)
    out = []
    for path, text, linked in found:
        if OTHER.intersection(path):
            out.append(False)
        else:
            out.append(bool(MAIN.intersection(path)) if named else len(text) >= 80 and linked * 3 < len(text))
    if not named and any(out):  # short paragraphs, items and headings between long texts, and the heading before them
        first, last = out.index(True), len(out) - out[::-1].index(True)
        while first and HEADINGS.intersection(found[first - 1][0]) and not OTHER.intersection(found[first - 1][0]):
            first -= 1
        out[first:last] = [not OTHER.intersection(path) and linked * 3 < len(text) for path, text, linked in found[first:last]]
    return out


def places(size: int) -> list[int]:
    """The blocks of a page in the fit: all, or equal runs from its start, its middle and its end."""
    if size <= FIT_BLOCKS:
        return list(range(size))
    run = FIT_BLOCKS // 3
    start = FIT_BLOCKS - 2 * run
    middle = start + (size - FIT_BLOCKS) // 2
    return [*range(start), *range(middle, middle + run), *range(size - run, size)]


def made_up(found: list[tuple[tuple[str, ...], str, int]], marks: list[bool], draw: random.Random) -> tuple[list, list[bool]]:
    """The blocks of a page in another layout: the texts stay, paths of other names take their place."""
    shell = ("html", "body", *(("div", draw.choice(("page", "wrapper", "container", "site"))) if draw.random() < 0.5 else ()))
    content = draw.choice((("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post"), ("section", "story"), ("div", "entry", "content")))
    short = [(t, n) for (_, t, n), m in zip(found, marks, strict=True) if not m] or [("more", 4)]
    texts = [t for (_, t, _), m in zip(found, marks, strict=True) if m]
    out: list = []
    flags: list[bool] = []

    def other(count: int) -> None:
        for _ in range(count):
            name = draw.choice(sorted(OTHER))
            outer = name if name in BLOCK_TAGS else "div"
            path = (*shell, *(content if draw.random() < 0.3 else ()), outer, *(() if outer == name else (name,)))
            for _ in range(draw.randint(1, 4)):
                text, linked = draw.choice(short) if draw.random() < 0.6 or not texts else (draw.choice(texts), 0)
                out.append(((*path, *draw.choice(((), ("p",), ("ul", "li", "a"), ("span",)))), text, linked if linked else 0))
                flags.append(False)

    other(draw.randint(1, 3))
    for i, text in enumerate(texts):
        if draw.random() < 0.05:
            other(1)
        inner = ("h1",) if i == 0 else draw.choice((("p",), ("p", "b"), ("p",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div",), ()))
        if draw.random() < 0.25:  # a paragraph may be a word or two
            text = " ".join(text.split(" ")[:draw.randint(1, 3)])
        out.append(((*shell, *content, *inner), text, 0))
        flags.append(True)
    other(draw.randint(1, 4))
    return out, flags


class Hashes(dict):
    """Word -> bucket."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        if len(self) < 200_000:
            self[word] = found
        return found


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]], words: Hashes, whole: int | None = None) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """The path of every block, and its word and count features, pages end to end; `whole`: blocks of the one page of which these are `places`."""
    flat = [b for page in pages for b in page]
    bag = np.zeros((len(flat), WORDS + COUNTS), np.float32)
    spread = np.fromiter((words[w] for _, text, _ in flat for w in text.split(" ")), np.int64)
    sizes = np.fromiter((text.count(" ") + 1 for _, text, _ in flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(flat)), sizes)
    if len(flat):
        bag[:, :WORDS] = np.bincount(owner * WORDS + spread, minlength=len(flat) * WORDS).reshape(-1, WORDS) / (WORD_SHARE * sizes[:, None])
        chars = np.asarray([len(t) for _, t, _ in flat], np.float32)
        bag[:, WORDS] = np.log1p(chars) / 8
        bag[:, WORDS + 1] = np.asarray([n for _, _, n in flat]) / chars
        bag[:, WORDS + 2] = np.log1p(sizes) / 6
        bag[:, WORDS + 3] = np.asarray([t[-1] in ".!?:\"'" for _, t, _ in flat])
        place = np.concatenate([np.arange(len(p)) for p in pages]) if whole is None else np.asarray(places(whole))
        total = np.repeat([len(p) for p in pages], [len(p) for p in pages]) if whole is None else whole
        bag[:, WORDS + 4] = place / total
        bag[:, WORDS + 5] = 1 / total
    return [p for p, _, _ in flat], bag


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATHS, np.float32)
    out[[zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATHS for name in path]] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block. Per direction: inputs, recurrence and bias of the four gates."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        size = PATHS + WORDS + COUNTS
        self.p = {f"{n}{d}": draw.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (
            ("x", 0.1, (size, 4 * HIDDEN)), ("h", 0.2, (HIDDEN, 4 * HIDDEN)), ("c", 0.0, (4 * HIDDEN,)))}
        self.p |= {"o": draw.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "z": np.zeros(1, np.float32)}

    def _inputs(self, paths: list[tuple[str, ...]], bag: np.ndarray, direction: str) -> np.ndarray:
        """Gate inputs of all blocks; those of a path are worked out once."""
        w = self.p["x" + direction]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(paths))}
        table = np.stack([path_vector(p) for p in distinct]) @ w[:PATHS]
        return table[[distinct[p] for p in paths]] + bag @ w[PATHS:] + self.p["c" + direction]

    def _run(self, inputs: np.ndarray, direction: str) -> list[tuple[np.ndarray, ...]]:
        """The states of each step; inputs: pages x steps x gates, padded at the end."""
        h = c = np.zeros((len(inputs), HIDDEN), np.float32)
        out = []
        for t in range(inputs.shape[1]):
            gates = inputs[:, t] + h @ self.p["h" + direction]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            before, last = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out.append((h, i, f, o, g, before, th, last))
        return out

    @staticmethod
    def _grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pages of these sizes: block numbers in order and in reverse order (pages x steps), and where there is a block."""
        steps = np.arange(int(sizes.max()))
        first = (np.cumsum(sizes) - sizes)[:, None]
        there = steps < sizes[:, None]
        return np.where(there, first + steps, 0), np.where(there, first + sizes[:, None] - 1 - steps, 0), there

    def scores(self, paths: list[tuple[str, ...]], bag: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The chance of each block to be main text; pages of similar length go together."""
        out = np.zeros(len(bag), np.float32)
        starts = np.cumsum(sizes) - sizes
        inputs = {d: self._inputs(paths, bag, d) for d in "fb"}
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            many = 1
            while at + many < len(order) and many < 512 and (many + 1) * sizes[order[at + many]] <= max(20_000, sizes[order[at]]):
                many += 1
            rows = order[at:at + many]
            at += many
            n = sizes[rows]
            ahead, back, there = self._grid(n)
            shift = (starts[rows] - (np.cumsum(n) - n))[:, None]
            logit = np.zeros(ahead.shape, np.float32)
            for d, index, w in (("f", ahead, self.p["o"][:HIDDEN]), ("b", back, self.p["o"][HIDDEN:])):
                states = self._run(inputs[d][np.where(there, index + shift, 0)], d)
                value = np.stack([s[0] @ w for s in states], 1)
                np.add.at(logit, (np.nonzero(there)[0], (index - (np.cumsum(n) - n)[:, None])[there]), value[there])
            out[(ahead + shift)[there]] = _sigmoid(logit[there] + self.p["z"])
        return out

    def fit(self, pages: list[list], marks: list[list[bool]], wholes: list[int], rounds: int = ROUNDS) -> Labeller:
        """Log-loss by Adam and back-propagation through time; of a page with `wholes` blocks, its `places` are given."""
        words, draw = Hashes(), np.random.default_rng(11)
        data = [(*vectors([p], words, n), np.asarray(m, np.float32)) for p, m, n in zip(pages, marks, wholes, strict=True) if p]
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for turn in range(rounds):
            order = draw.permutation(len(data))
            for first in range(0, len(order), BATCH):
                part = [data[i] for i in order[first:first + BATCH]]
                gradient = self._gradient([p for d in part for p in d[0]], np.concatenate([d[1] for d in part]),
                                          np.asarray([len(d[2]) for d in part]), np.concatenate([d[2] for d in part]))
                step += 1
                for k, g in gradient.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * FALL**turn * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-6)
        return self

    def _gradient(self, paths: list, bag: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        ahead, back, there = self._grid(sizes)
        full = np.concatenate([np.stack([path_vector(p) for p in paths]), bag], 1)
        states, blocks_of, hidden = {}, {"f": ahead, "b": back}, np.zeros((len(bag), 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            inputs = full @ self.p["x" + d] + self.p["c" + d]
            states[d] = self._run(inputs[blocks_of[d]], d)
            h = np.stack([s[0] for s in states[d]], 1)
            hidden[blocks_of[d][there], k * HIDDEN:(k + 1) * HIDDEN] = h[there]
        error = (_sigmoid(hidden @ self.p["o"] + self.p["z"]) - truth) / len(sizes)
        out = {"o": hidden.T @ error + 1e-4 * self.p["o"], "z": error.sum(keepdims=True)}
        for k, d in enumerate("fb"):
            index = blocks_of[d]
            outer = np.where(there, error[index], 0)[:, :, None] * self.p["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dh = dc = np.zeros((len(sizes), HIDDEN), np.float32)
            rec, gates_of = np.zeros_like(self.p["h" + d]), np.zeros((len(bag), 4 * HIDDEN), np.float32)
            for t in range(index.shape[1] - 1, -1, -1):
                _, i, f, o, g, before, th, last = states[d][t]
                dh = dh + outer[:, t]
                dc = dc + dh * o * (1 - th * th)
                gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
                rec += last.T @ gates
                gates_of[index[there[:, t], t]] = gates[there[:, t]]
                dh, dc = gates @ self.p["h" + d].T, dc * f
            out["x" + d], out["h" + d], out["c" + d] = full.T @ gates_of, rec, gates_of.sum(0)
        return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Labeller:
    """A labeller from at most `fit_pages` different pages of (page_id, html), by a hash of both; their blocks reach the driver."""
    rows = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "html").alias("pick"), "html")
    chosen = rows.select("pick").distinct().orderBy("pick").limit(fit_pages)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for pick, page in zip(batch["pick"], batch["html"], strict=True):
                if pick in seen:
                    continue
                seen.add(pick)
                found = leaves(page)
                flags = teacher(found)
                held = [(found[i][0], found[i][1][:FIT_CHARS].rstrip(), min(found[i][2], FIT_CHARS), flags[i]) for i in places(len(found))]
                out.append((pick, len(found), json.dumps(held)))
            yield pd.DataFrame(out, columns=["pick", "whole", "held"])

    got = rows.join(F.broadcast(chosen), "pick").mapInPandas(cut, "pick long, whole int, held string").dropDuplicates(["pick"]).collect()
    sample = [(r["whole"], [(tuple(path), text, linked, flag) for path, text, linked, flag in json.loads(r["held"])]) for r in sorted(got)]
    draw = random.Random(5)
    marked = any(flag for _, held in sample for *_, flag in held)
    found, marks, wholes = [], [], []

    def add(one: list, flags: list[bool], whole: int | None = None) -> None:
        kept = range(len(one)) if whole is not None else places(len(one))
        found.append([one[i] for i in kept])
        marks.append([flags[i] for i in kept])
        wholes.append(len(one) if whole is None else whole)

    used = [s for s in sample if s[1]] or [(0, [])]
    turns = -(-FIT_PAGES // len(used))  # a small sample is used often enough for a whole fit
    for whole, held in used:
        blocks_, flags = [b[:3] for b in held], [b[3] for b in held]
        if marked:
            for _ in range(turns):
                add(blocks_, flags, whole)
        else:  # any texts outside boilerplate will do for the made-up pages
            flags = [not OTHER.intersection(path) for path, _, _ in blocks_]
        for _ in range(MADE_UP * turns):
            stock = [] if marked else draw.sample(STOCK, 8)
            add(*made_up([*blocks_, *stock], flags + [True] * len(stock), draw))
    return Labeller().fit(found, marks, wholes)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    model = fit(rows, fit_pages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for block, texts in blocks(batches, 1_000_000, "html"):
            found = [leaves(t) for t in texts]
            sizes = np.asarray([len(f) for f in found], np.int64)
            keep = model.scores(*vectors(found, words), sizes) >= 0.5 if sizes.sum() else np.zeros(0, bool)
            ends = np.cumsum(sizes)
            out = [" ".join(b[1] for b, k in zip(f, keep[e - n:e], strict=True) if k) for f, n, e in zip(found, sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, SCHEMA)

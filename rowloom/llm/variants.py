"""Groups of spelling variants by a dictionary of trie-node pairs (operator 11).

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Every prefix of a word is a node of a forward trie and every suffix
a node of a reversed one; nodes are numbered, so that a word split in two
is a pair of integers (prefix node, suffix node). A word that skips one
position and another that does the same at the same pair differ by a
replacement; a word that skips a position meets the word without it at that
word's split. So equal pairs are the exact neighbours, and no text is compared.

A trie is numbered by sorting the words over ranges: a word takes the nodes of
the prefix it shares with the word before it and new numbers for the rest. What
crosses from one range to the next is mended with one word per range. A key has
at most one splitting word and one skipping word per letter of the alphabet,
and each of its members gets the count and the best of the others from the
key's first two, so no pairs are made. Where equal letters stand together only
the first of them may be left out, so that each neighbour counts once.

A word's form is its near word with the largest count (ties: the smallest in
code-point order), if that is at least `ratio` times the word's own; its root
ends the chain of forms. Counts grow along a chain, so chains are short.

Null words and words with a null count are left out, the counts of repeated
words are added, an empty word is a word, an empty table gives an empty
result. Other columns are not read. A very long word makes twice as many
integer keys as it has letters, never copies of itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import blocks, parts_of

#: A form's count is at least so many times the word's.
RATIO = 5
#: Numbers of words and nodes that a range may use.
RANGE_BITS = 40
#: Letters of words that a task turns into keys at once.
BLOCK = 200_000

NUMBERED = "part long, rank long, path string, nodes array<long>"
KEYS = "head long, tail long, rank long, n long, kind byte"
#: A word split at a place, a word that skips a letter there, and one that skips the first of equal letters.
SPLIT, SKIP, SKIP_FIRST = 0, 1, 2


def runs(docs: DataFrame, letters: str = r"A-Za-zÀ-ÿ", least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run) of every maximal run of at least `least` letters; only A-Z are lower-cased. A null text has none."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"[{letters}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), found.alias("run"))
    return rows.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # halving compares slices, which is fast for long words too
    while low < n:
        middle = (low + n + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            n = middle - 1
    return low


def number_nodes(paths: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Number the trie of the distinct `path`s: (part, rank, path, nodes) and the true numbers of nodes that cross ranges.

    `nodes` has the numbers of the prefixes of 0, 1, .. letters; ranks follow the order of the paths. The driver
    receives the first and the last path of every range.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rank = used = part << RANGE_BITS
        last, nodes = "", np.zeros(0, np.int64)
        for block, texts in (b for batch in batches for b in blocks([batch], BLOCK, "path")):
            out = []
            for path in texts:
                common = shared(last, path) + 1 if len(nodes) else 0
                fresh = len(path) + 1 - common
                last, nodes = path, np.concatenate([nodes[:common], np.arange(used, used + fresh)])
                used += fresh
                out.append(nodes)
            size = np.cumsum([0, *map(len, out)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(out), part)), pa.array(np.arange(rank, rank + len(out))), block.column(0),
                pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(out)))], ["part", "rank", "path", "nodes"])
            rank += len(out)

    dealt = paths.select("path").repartitionByRange(parts_of(paths), "path").sortWithinPartitions("path")
    table = written(dealt.mapInArrow(work, NUMBERED), "trie")
    row = F.struct("path", "nodes")
    ends = table.groupBy("part").agg(F.min_by(row, "rank").alias("first"), F.max_by(row, "rank").alias("last")).orderBy("part")
    true: dict[int, int] = {}
    before: tuple[str, list[int]] | None = None
    for r in ends.toLocalIterator():
        if before is not None:
            both = shared(before[0], r["first"]["path"]) + 1
            true.update(zip(r["first"]["nodes"][:both], before[1][:both], strict=True))
        before = r["last"]["path"], [true.get(x, x) for x in r["last"]["nodes"]]
    return table, true


def keys(words: DataFrame, heads: dict[int, int], tails: dict[int, int]) -> DataFrame:
    """The pairs (head, tail) of words (path, rank, n, heads, tails): of every split, and of every skipped letter."""
    names = [(np.array(sorted(t), np.int64), np.array([t[k] for k in sorted(t)], np.int64)) for t in (heads, tails)]

    def flat(column: pa.ListArray, name: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(name[0]):
            at = np.minimum(np.searchsorted(name[0], found), len(name[0]) - 1)
            found = np.where(name[0][at] == found, name[1][at], found)
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in (b for batch in batches for b in blocks([batch], BLOCK, "path")):
            head, tail = flat(block.column(3), names[0]), flat(block.column(4), names[1])
            places = np.array([len(t) + 1 for t in texts])
            starts = np.cumsum(places) - places
            owner = np.repeat(np.arange(len(texts)), places)
            at = np.arange(len(owner)) - starts[owner]
            other = (starts + places - 1)[owner] - at  # the suffix node after `at` letters
            skips = np.flatnonzero(at < places[owner] - 1)
            letter = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            first = np.ones(len(letter), bool)
            first[1:] = letter[1:] != letter[:-1]
            kind = np.where(first | (at[skips] == 0), SKIP_FIRST, SKIP)
            owner_of = np.concatenate([owner, owner[skips]])
            rank, n = (block.column(i).to_numpy(zero_copy_only=False)[owner_of] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([head, head[skips]])), pa.array(np.concatenate([tail[other], tail[other[skips] - 1]])), pa.array(rank), pa.array(n),
                pa.array(np.concatenate([np.full(len(head), SPLIT), kind]).astype(np.int8))], ["head", "tail", "rank", "n", "kind"])

    return words.select("path", "rank", "n", "heads", "tails").mapInArrow(work, KEYS)


def near_words(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best_n, best): the number of near words and the best of them, from the keys; words without one are absent."""
    member = F.struct((-F.col("n")).alias("order"), "rank", "kind")
    groups = pairs.groupBy("head", "tail").agg(F.array_sort(F.collect_list(member)).alias("m")).where(F.size("m") > 1)
    skips = F.filter("m", lambda x: x["kind"] > SPLIT)
    firsts = F.filter("m", lambda x: x["kind"] == SKIP_FIRST)
    groups = groups.select("m", F.size(skips).alias("n_skips"), F.get(skips, F.lit(0)).alias("one"), F.get(skips, F.lit(1)).alias("two"),
                           F.size(firsts).alias("n_firsts"), F.get(firsts, F.lit(0)).alias("long"),
                           F.get(F.filter("m", lambda x: x["kind"] == SPLIT), F.lit(0)).alias("short"))
    each = groups.withColumn("x", F.explode("m"))
    is_short, meets_short = F.col("x.kind") == SPLIT, (F.col("x.kind") == SKIP_FIRST) & F.col("short").isNotNull()
    many = F.when(is_short, F.col("n_firsts")).otherwise(F.col("n_skips") - 1 + meets_short.cast("int"))
    other = F.when(F.col("one.rank") == F.col("x.rank"), F.col("two")).otherwise(F.col("one"))
    best = F.when(is_short, F.col("long")).otherwise(F.least(other, F.when(meets_short, F.col("short"))))
    found = each.select(F.col("x.rank").alias("rank"), many.alias("many"), F.struct(best["order"].alias("order"), best["rank"].alias("rank")).alias("best"))
    found = found.where("many > 0").groupBy("rank").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))
    return found.select("rank", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.rank").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) at the end of the chains of (rank, form); each round doubles the steps."""
    found = written(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        more = found.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        if found.join(more, "root", "left_semi").isEmpty():
            return found
        found = written(found.join(more, "root", "left").select("rank", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(words: DataFrame, ratio: int = RATIO, word: str = "word", n: str = "n") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    path, count = F.col(f"`{word}`").cast("string").alias("path"), F.col(f"`{n}`").cast("long").alias("n")
    counted = written(words.select(path, count).where("path IS NOT NULL AND n IS NOT NULL").groupBy("path").agg(F.sum("n").alias("n")), "words")
    forward, heads = number_nodes(counted)
    backward, tails = number_nodes(counted.select(F.reverse("path").alias("path")))
    named = forward.select("path", "rank", F.col("nodes").alias("heads")).join(counted, "path")
    named = named.join(backward.select(F.reverse("path").alias("path"), F.col("nodes").alias("tails")), "path")
    near = near_words(keys(named, heads, tails))
    ranked = forward.select("path", "rank").join(counted, "path").join(near, "rank", "left")
    ranked = written(ranked.withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))), "near")
    ends = roots(ranked.where("form IS NOT NULL").select("rank", "form"))
    out = ranked.join(ends, "rank", "left")
    for name in ("form", "root"):
        out = out.join(forward.select(F.col("rank").alias(name), F.col("path").alias(f"{name}_word")), name, "left")
    return out.select(F.col("path").alias("word"), F.col("form_word").alias("form"), F.coalesce("root_word", "path").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))

"""Near-duplicate documents by a chosen-path set similarity join (operator 6).

A document's set is the set of its distinct five-word shingles after
lower-casing A-Z; a text of fewer words is one shingle, a text without words
has an empty set and no links. Two documents are linked when the intersection
of their sets is at least 75 % of the union, and the links' components are the
groups.

Documents with equal sets are one node from the start. A tree begins with all
nodes; at each branching a few minwise tokens are selected by the branch's own
seed from all that a set has, and every member goes to the child of each selected token's value.
Similar sets share tokens, so with two tokens a branching the path of a pair
at the threshold goes on with a probability of 0.89 per tree whatever its
depth, and independent trees bring the miss of one pair under 1e-5.

Each level of all trees is a table (branch, node). Branches with one member
are dropped. In every other one the members are compared with its hubs first,
nodes that many members resemble (the text that copies were made from); what
is confirmed on full sets joins components at once. Branches whose members are
all in one component need no more work. In the other small branches a task finds
the members that resemble a member of another component, and only those members, no pairs,
leave it: a second task gets their texts, tests the pairs on full sets and gives the links that join
components, at most one less than it has members. Larger branches branch again.
After the first level, branches of medium size are cut in blocks and all block
pairs are compared, and at DEEPEST levels all that are left, so that no
candidate is lost.

Null and empty texts are components of their own. Null doc_ids never
represent a group that has another one. Documents that share a doc_id are
told apart by their sets. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import blocks, hold, mix64, parts_of, ragged, text_of
from .links import components

WORDS, SHARE = 5, 75
#: Minwise tokens of a set, which branchings select from and of which a one-byte hash each serves for estimates; trees.
TOKENS, TREES = 256, 6
#: Share of equal bytes from which a pair is confirmed on full sets: 3.7 standard deviations under the threshold.
LIKELY = 0.65
#: Members of a branch that are compared with each other; of one that is compared block by block, after the first level; levels until all
#: larger ones are; pairs that share a group in a confirmation with a hub.
SMALL, MEDIUM, DEEPEST, TOGETHER = 256, 4096, 10, 48
#: Members of a block whose bytes or full sets are compared with another block's; shingles of a block whose full sets are.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Words whose hashes a worker keeps; it changes no result.
KEPT_WORDS = 150_000

SET = "doc_id long, digest binary, key long, n long, tokens binary, bytes binary"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    if len(_words) > KEPT_WORDS:
        _words.clear()
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and blanks are \x20 \x09-\x0d
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    span = min(WORDS, len(words))
    many = len(words) - span + 1
    with np.errstate(over="ignore"):
        total = np.full(many, span, np.uint64)
        for i in range(span):  # a polynomial of the words' hashes, scrambled once
            total *= GOLDEN
            total += words[i:i + many]
    total = mix64(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _seeds(tokens: int) -> np.ndarray:
    return (mix64(np.arange(1, tokens + 1, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minwise(sets: list[np.ndarray], tokens: int = TOKENS) -> np.ndarray:
    """For each set and token the least value of one 32-bit hash function over the set: a multiple of an element's upper half plus its lower one."""
    out = np.empty((len(sets), tokens), np.uint32)
    seeds = _seeds(tokens)[:, None]
    for i, found in enumerate(sets):
        upper, lower = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
        for first in range(0, len(found), 1024):
            value = upper[first:first + 1024] * seeds
            value += lower[first:first + 1024]
            here = value.min(1)
            out[i] = here if not first else np.minimum(out[i], here)
    return out


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), key (a 64-bit hash of the set), n, the minwise tokens and a byte for each of them of every row of
    (doc_id, text), written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        for block, texts in blocks(batches, 1_000_000):
            found = [shingles(t) for t in texts]
            full = [i for i, s in enumerate(found) if len(s)]
            tokens = minwise([found[i] for i in full]).astype("<u4")
            low = (tokens * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            whole: list[bytes | None] = [None] * len(texts)
            lowest: list[bytes | None] = [None] * len(texts)
            for i, row, least in zip(full, tokens, low, strict=True):
                whole[i], lowest[i] = row.tobytes(), least.tobytes()
            yield pa.RecordBatch.from_arrays([
                block.column(0), block.column(2), pa.array([set_key(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                pa.array(whole, pa.binary()), pa.array(lowest, pa.binary())], ["doc_id", "digest", "key", "n", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    return written(rows.mapInArrow(work, SET), "sets")


def set_key(found: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())))) if len(found) else None


def _children(branch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Two children of each (branch, member): the branch selects two different tokens, the member's values name the children."""
    many = tokens.shape[1]
    first = (mix64(branch + GOLDEN) % np.uint64(many)).astype(np.int64)
    second = (first + 1 + (mix64(branch ^ GOLDEN) % np.uint64(many - 1)).astype(np.int64)) % many
    rows = np.arange(len(branch))
    with np.errstate(over="ignore"):
        return np.stack([mix64(mix64(branch * GOLDEN + at.astype(np.uint64) + np.uint64(1)) + tokens[rows, at].astype(np.uint64)) for at in (first, second)], 1)


def _bytes(column: pa.Array) -> np.ndarray:
    """A byte of every token, for estimates."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), TOKENS)


def resemblance(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of equal bytes of each of `rows` with the same one of `others`, or with `others` if that is one row."""
    equal = (rows == others).view(np.uint64)
    # eight counts to a word, a byte each: TOKENS / 8 at most
    return np.add.reduce(equal, 1).view(np.uint8).reshape(len(rows), 8).sum(1) / TOKENS


def branch_out(members: DataFrame, root: bool) -> DataFrame:
    """The next level (branch, key) of members (branch, key, tokens); from the root all trees start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tokens = batch.column(1), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(batch.num_rows, TOKENS)
            branch = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            trees = TREES if root else 1
            found = np.concatenate([_children(mix64(branch + np.uint64(t + 1)) if root else branch, tokens) for t in range(trees)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(key.to_numpy(zero_copy_only=False), found.shape[1]))],
                                             ["branch", "key"])

    return members.mapInArrow(work, "branch long, key long")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose tokens agree often enough."""
    tokens = sets.select("key", "bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = resemblance(_bytes(batch.column(2)), _bytes(batch.column(3))) >= LIKELY
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(tokens.withColumnsRenamed({"key": "a", "bytes": "ta"}), "a").join(tokens.withColumnsRenamed({"key": "b", "bytes": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def by_branch(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply `work` to runs of whole branches of batches that are sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        branch = batch.column(0).to_numpy()
        cut = int(np.searchsorted(branch, branch[-1], "left"))  # the last branch may go on
        if held and (cut or held[-1].column(0)[-1].as_py() != branch[0]):
            yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield work(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield work(pa.Table.from_batches(held))


def hubs(members: DataFrame) -> DataFrame:
    """(a, b, branch, score): each member b of a block of a branch with the hub a that it resembles; members: block, branch, key, bytes.

    The member with the highest mean resemblance is the first hub; the next one is the best of those that no hub so far
    resembles. A member is paired once, so a block gives fewer rows than it has.
    """

    def pairs(table: pa.Table) -> pa.RecordBatch:
        block, branch, key = (table.column(c).to_numpy() for c in ("block", "branch", "key"))
        tokens = _bytes(table.column("bytes").combine_chunks())
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        two = cuts[:-1][np.diff(cuts) == 2]
        good = resemblance(tokens[two], tokens[two + 1])
        two, good = two[good >= LIKELY], good[good >= LIKELY]
        out = [(key[two], key[two + 1], branch[two], good)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            if last - first < 3:
                continue
            rows = tokens[first:last]
            alike = np.stack([resemblance(rows, row) for row in rows])
            mean, open_ = alike.mean(1), np.ones(len(rows), bool)
            for hub in np.lexsort((key[first:last], -mean)):
                if open_[hub]:
                    open_[hub] = False
                    near = np.flatnonzero(open_ & (alike[hub] >= LIKELY))
                    open_[near] = False
                    if len(near):
                        full = [np.full(len(near), x) for x in (key[first + hub], branch[first], mean[hub])]
                        out.append((full[0], key[first + near], full[1], full[2]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "branch", "score"])

    dealt = members.select("block", "branch", "key", "bytes").repartition(parts_of(members), "block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(lambda batches: by_branch(batches, pairs), "a long, b long, branch long, score double")


def first_pairs(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely pairs of members with hubs: within blocks of SMALL members, and of a larger branch with its best hub."""
    tokens = sets.select("key", "bytes")
    block = F.when(F.col("n") > SMALL, F.xxhash64("branch", F.pmod(F.xxhash64("key", F.lit("block")), F.ceil(F.col("n") / SMALL)))).otherwise(F.col("branch"))
    found = written(hubs(live.withColumn("block", block).join(tokens, "key")), "hubs")
    best = found.groupBy("branch").agg(F.max_by("a", "score").alias("a"))
    stars = live.where(F.col("n") > SMALL).join(best, "branch").where("a != key").select("a", F.col("key").alias("b")).distinct()
    pairs = found.select("a", "b").union(likely(stars, sets))
    one = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by(F.struct("a", "b"), "a").alias("p"))
    return one.select("p.a", "p.b")  # the hub stays first, so that the pairs of one hub are confirmed together


def open_members(members: DataFrame) -> DataFrame:
    """(branch, key, label) of the members that resemble one of another component in their group; members: group, branch, key, label,
    bytes. A group's rows are few, and no more rows leave than came."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        group, branch, key, label = (table.column(c).to_numpy() for c in ("group", "branch", "key", "label"))
        tokens = _bytes(table.column("bytes").combine_chunks())
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        end = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
        left, is_open = np.arange(len(group)), np.zeros(len(group), bool)
        step = 1
        while True:
            left = left[left + step < end[left]]
            if not len(left):
                break
            i = left[label[left] != label[left + step]]
            i = i[~(is_open[i] & is_open[i + step])]
            for part in np.array_split(i, len(i) // 20_000 + 1):
                good = part[resemblance(tokens[part], tokens[part + step]) >= LIKELY]
                is_open[good] = is_open[good + step] = True
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(c[is_open]) for c in (branch, key, label)], ["branch", "key", "label"])

    dealt = members.select("group", "branch", "key", "label", "bytes").repartition(parts_of(members), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda batches: by_branch(batches, compared), "branch long, key long, label long").distinct()


def with_texts(needs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `needs` (doc_id, ..) with the texts of their doc_id.

    Before the texts are shuffled, rows that none needs are mostly left out by a table of at most 65,536 words of bits.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 22))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = needs.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select("doc_id", "text", slot.alias("slot")).withColumn("word", F.expr("slot div 64"))
    texts = texts.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).select(F.col("doc_id").alias("id"), "text")
    return needs.join(texts, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")


def are_linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    if min(len(a), len(b)) * 100 < share * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= share * (len(a) + len(b) - common)


def joining_links(members: DataFrame, docs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Links (a, b) between components, tested on full sets, that join what belongs together in each branch; members: branch, key, label.

    A branch with many members, or with large sets, is cut in blocks of which every two meet in one task.
    """
    sized = members.join(sets.select("key", "doc_id", "n", "bytes"), "key")
    whole = Window.partitionBy("branch")
    parts = F.greatest(F.ceil(F.count("*").over(whole) / BLOCK), F.ceil(F.sum("n").over(whole) / BLOCK_SHINGLES)).cast("int")
    rows = blocked(sized.withColumn("blocks", parts))
    needs = written(rows.select("group", "key", "label", "doc_id", "bytes"), "needs")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        hold("neardup", _words.clear)
        found: dict[int, tuple[np.ndarray, int, bytes]] = {}
        for key, label, low, text in zip(group["key"], group["label"], group["bytes"], group["text"], strict=True):
            if key not in found and set_key(one := shingles(text)) == key:
                found[key] = one, label, low
        if not found:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        keys, (full, labels, low) = list(found), zip(*found.values(), strict=True)
        tokens = np.frombuffer(b"".join(low), np.uint8).reshape(len(keys), TOKENS)
        lengths = np.fromiter(map(len, full), np.int64, len(full))
        starts = np.cumsum(lengths) - lengths
        names, shingle = np.unique(np.concatenate(full), return_inverse=True)
        marked = np.zeros(len(names), bool)
        parent = {x: x for x in labels}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        of = np.asarray(labels)
        out = []
        for i in range(len(keys) - 1):
            rest = i + 1 + np.flatnonzero(of[i + 1:] != of[i])
            near = rest[resemblance(tokens[rest], tokens[i]) >= LIKELY]
            near = near[[top(x) != top(labels[i]) for x in of[near].tolist()]] if len(near) else near
            if not len(near):
                continue
            mine = shingle[starts[i]:starts[i] + lengths[i]]
            marked[mine] = True  # the sizes of all intersections with this set at once
            common = np.add.reduceat(marked[shingle[ragged(starts[near], lengths[near])]], np.cumsum(lengths[near]) - lengths[near], dtype=np.int64)
            marked[mine] = False
            for j in near[100 * common >= share * (lengths[i] + lengths[near] - common)].tolist():
                a, b = top(labels[i]), top(labels[j])
                if a != b:
                    parent[a] = b
                    out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return with_texts(needs, docs).select("group", "key", "label", "bytes", "text").groupBy("group").applyInPandas(work, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose full sets have an intersection of `share` % of the union.

    Pairs of one `a` are dealt to groups of about TOGETHER, to each of which
    the texts are sent once.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    members = dealt.select("a", "part", F.col("b").alias("key")).union(dealt.select("a", "part", F.col("a").alias("key")).distinct())
    needs = written(members.join(sets.select("key", "doc_id"), "key").select("doc_id", "key", "a", "part"), "needs")
    rows = with_texts(needs, docs).select("a", "part", "key", "text")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        hold("neardup", _words.clear)
        a = int(group["a"].iloc[0])
        found: dict[int, np.ndarray] = {}
        for key, text in zip(group["key"], group["text"], strict=True):
            if key not in found and set_key(one := shingles(text)) == key:
                found[key] = one
        good = [key for key, other in found.items() if key != a and are_linked(found[a], other, share)]
        return pd.DataFrame({"a": np.full(len(good), a, np.int64), "b": np.asarray(good, np.int64)})

    return rows.groupBy("a", "part").applyInPandas(work, "a long, b long")


def blocked(members: DataFrame) -> DataFrame:
    """Branches (branch, key, .., blocks) as groups: every pair of blocks of a branch is a group."""
    rows = members.withColumn("i", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.where((F.col("blocks") == 1) | (F.col("i") != F.col("j")))  # a pair of blocks holds the pairs within each as well
    return rows.withColumn("group", F.xxhash64("branch", F.least("i", "j"), F.greatest("i", "j"))).drop("i", "j", "blocks")


def near_links(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Confirmed links (a, b) between nodes and the components (node, label) that they form; None where there is no link."""
    links: DataFrame | None = None
    groups: DataFrame | None = None
    tested: list[DataFrame] = []
    whole = Window.partitionBy("branch")
    level = branch_out(sets.select(F.lit(0).cast("long").alias("branch"), "key", "tokens"), True)
    for depth in range(1, DEEPEST + 1):
        live = written(level.withColumn("n", F.count("*").over(whole)).where("n > 1"), "branches")
        if live.isEmpty():
            break
        links, groups = _grow(links, groups, tested, apart(first_pairs(live, sets), groups), docs, sets)
        labelled = named(live, groups, "key", "label").withColumns({"low": F.min("label").over(whole), "high": F.max("label").over(whole)})
        labelled = written(labelled.where("low != high").drop("low", "high"), "open")
        most = SMALL if depth == 1 < DEEPEST else MEDIUM
        large = labelled.where(F.col("n") > most) if depth < DEEPEST else None
        compared = labelled if large is None else labelled.where(F.col("n") <= most)
        groups_ = blocked(compared.select("branch", "key", "label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        opened = written(open_members(groups_.join(sets.select("key", "bytes"), "key")), "open-members")
        if not opened.isEmpty():
            found = written(joining_links(opened, docs, sets), "links")
            links, groups = _joined(links, groups, found)
        if large is None or large.isEmpty():
            break
        level = branch_out(large.join(sets.select("key", "tokens"), "key").select("branch", "key", "tokens"), False)
    return links, groups


def named(rows: DataFrame, groups: DataFrame | None, node: str, label: str) -> DataFrame:
    """`rows` with the component of the column `node` so far; a node without links is its own."""
    if groups is None:
        return rows.withColumn(label, F.col(node))
    found = groups.withColumnsRenamed({"node": node, "label": "__found"})
    return rows.join(found, node, "left").withColumn(label, F.coalesce("__found", node)).drop("__found")


def apart(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The pairs that are not in one component already: a further link would change nothing."""
    return pairs if groups is None else named(named(pairs, groups, "a", "la"), groups, "b", "lb").where("la != lb").select("a", "b")


def _grow(links: DataFrame | None, groups: DataFrame | None, tested: list[DataFrame], pairs: DataFrame, docs: DataFrame,
          sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The links and components with those of the candidate pairs that full sets confirm; no pair is confirmed twice."""
    if tested:
        done = reduce(DataFrame.union, tested).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        pairs = pairs.join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    pairs = written(pairs, "pairs")
    tested.append(pairs)
    if pairs.isEmpty():
        return links, groups
    return _joined(links, groups, written(confirm(pairs, docs, sets), "links"))


def _joined(links: DataFrame | None, groups: DataFrame | None, found: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The links with those found, and the components that they form."""
    if found.isEmpty():
        return links, groups
    links = found if links is None else links.union(found)
    # components so far stand for their links
    edges = found if groups is None else found.union(groups.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return links, written(components(edges), "components")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept, digest (of the text) and group (a number of
    the component, null without words), by which rows that share a doc_id can be told apart."""
    rows = text_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    every = sets_of(rows)
    sets = written(every.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"), F.min("bytes").alias("bytes"), F.min("n").alias("n")), "nodes")
    _, groups = near_links(rows, sets)
    labelled = named(sets.select("key", "doc_id"), groups, "key", "label")
    least = labelled.join(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("key", "component_id", F.col("label").alias("group"))
    out = every.select("doc_id", "digest", "n", "key").join(written(least, "named"), "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest", "group")

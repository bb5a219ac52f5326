"""Hierarchical packing of token ids into context windows of several sizes (operator 10).

Tiers are the powers of two up to the longest window. A document is routed
by size: whole windows of the longest tier are cut from it first, and what is
left goes to the shortest tier that holds it. Each tier is packed by itself,
longest tier and largest rest first: a rest opens a window of its own tier, and
the gap is filled from shorter tiers only, the last filler being cut to fit.
Where the shorter tiers have too few ids for a gap, the rest's first half-window
is a sequence of the next tier and its remainder goes to the tier that holds
it, so that no sequence has padding. Windows of one tier are dealt to step
groups of equal numbers of ids.

A null or empty text gives one piece with the end id. Repeated rows and null
document ids are packed like others; an empty table gives an empty result.
Tasks pack apart from each other, so that memory is bounded by one block.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .common import blocks, prefix_sums, text_of
from .tokens import BLOCK_CHARS, encoder

PIECES = "part int, local_sequence long, tier int, tier_rank long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"
#: Ids that are packed together at most, besides a document that is longer by itself.
BLOCK_IDS = 1_500_000
#: Rows of bases (parts times tiers) that are broadcast: 4 MB.
MOST_BASES = 100_000
#: Ids of one step group.
STEP_IDS = 1 << 20


def pack_tiers(sizes: np.ndarray, longest: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of each sequence, which has as many ids as its tier.

    Each window of a tier opens with a rest of that tier, which is longer than
    half of it; all further pieces come from shorter tiers.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests: dict[int, list[tuple[int, int]]] = {}  # length -> (document, start), the next one last
    for doc in range(len(sizes) - 1, -1, -1):
        full, rest = divmod(int(sizes[doc]), longest)
        out.extend([(doc, k * longest, longest)] for k in range(full))
        if rest:
            rests.setdefault(rest, []).append((doc, full * longest))
    lengths = sorted(rests)

    def take(at: int) -> tuple[int, int, int]:
        length = lengths[at]
        doc, start = rests[length].pop()
        if not rests[length]:
            del rests[length], lengths[at]
        return doc, start, length

    def put(doc: int, start: int, length: int) -> None:
        if length not in rests:
            rests[length] = []
            bisect.insort(lengths, length)
        rests[length].append((doc, start))

    tier = shorter = 0
    while lengths:
        size = 1 << (lengths[-1] - 1).bit_length()
        if size != tier:  # ids of the shorter tiers
            tier, shorter = size, sum(n * len(rests[n]) for n in lengths if 2 * n <= size)
        doc, start, length = take(-1)
        room = tier - length
        if shorter < room:
            half = tier // 2
            out.append([(doc, start, half)])
            put(doc, start + half, length - half)
            shorter += length - half
            continue
        window = [(doc, start, length)]
        shorter -= room
        while room:
            at = bisect.bisect_right(lengths, room) - 1
            doc, start, length = take(max(at, 0))
            if at < 0:  # nothing fits: the shortest rest is cut
                put(doc, start + room, length - room)
                length = room
            window.append((doc, start, length))
            room -= length
        out.append(window)
    return out


def pack_block(sizes: np.ndarray, longest: int) -> list[list[tuple[int, int, int]]]:
    """Like `pack_tiers`, with windows of one size for all: plain best fit, which `pack` does not use.

    Whole long windows first; then, tier by tier from the largest rest, a
    window takes the largest rest that still fits, and a smaller tier's rest
    is cut when none fits; the last window is split by powers of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int]] = []  # (length, -document), ascending
    for doc, size in enumerate(sizes.tolist()):
        full, rest = divmod(size, longest)
        out.extend([(doc, k * longest, longest)] for k in range(full))
        if rest:
            rests.append((rest, -doc))
    rests.sort()
    while rests:
        window: list[tuple[int, int, int]] = []
        room = longest
        while room and rests:
            at = bisect.bisect_right(rests, (room, 0)) - 1
            if at < 0:  # nothing fits: the shortest rest is cut
                length, doc = rests[0]
                window.append((-doc, int(sizes[-doc]) - length, room))
                rests[0] = (length - room, doc)
                room = 0
                break
            length, doc = rests.pop(at)
            window.append((-doc, int(sizes[-doc]) - length, length))
            room -= length
        if not room:
            out.append(window)
            continue
        out.extend(by_powers(window, longest - room))
    return out


def by_powers(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut the ids of a window into sequences of falling powers of two."""
    out, at = [], 0
    for bit in range(total.bit_length() - 1, -1, -1):
        need = (total >> bit & 1) << bit
        part: list[tuple[int, int, int]] = []
        while need:
            doc, start, length = window[at]
            take = min(need, length)
            part.append((doc, start, take))
            need -= take
            if take == length:
                at += 1
            else:
                window[at] = (doc, start + take, length - take)
        if part:
            out.append(part)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048, key: str = "doc_id", text: str = "text",
         step_ids: int = STEP_IDS, kept_chunks: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids (32-bit, little-endian).

    The pieces are written once under the shared folder; sequence numbers
    start at each part's prefix sum, of which the driver gets one row per
    part and tier. `kept_chunks` bounds a worker's table of encoded chunks and changes no result.
    """
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = encoder(tokenizer, kept_chunks)
        done = {"sequences": 0}
        ranks: dict[int, int] = {}
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        waiting = 0
        for block, texts in blocks(batches, BLOCK_CHARS):
            ids, counts = table.encode(texts)
            full = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            held.append((block.column(0).to_pylist(), full, counts + 1))
            del block, texts, ids  # else the next batch is read beside this one
            waiting += len(full)
            if waiting >= BLOCK_IDS:
                yield rows(part, held, done, ranks)
                held, waiting = [], 0
        if held:
            yield rows(part, held, done, ranks)

    def rows(part: int, held: list, done: dict, ranks: dict[int, int]) -> pa.RecordBatch:
        keys = [k for ks, _, _ in held for k in ks]
        flat = np.concatenate([f for _, f, _ in held])
        sizes = np.concatenate([c for _, _, c in held])
        base = np.cumsum(sizes) - sizes
        seq, tier, rank, offset, doc, start, length = ([] for _ in range(7))
        for window in pack_tiers(sizes, longest):
            size, at = sum(p[2] for p in window), 0
            for d, s, n in window:
                seq.append(done["sequences"]), tier.append(size), rank.append(ranks.get(size, 0)), offset.append(at)
                doc.append(d), start.append(s), length.append(n)
                at += n
            done["sequences"] += 1
            ranks[size] = ranks.get(size, 0) + 1
        many = len(seq)
        doc, start, length = (np.asarray(x, np.int64) for x in (doc, start, length))
        order = np.argsort(base[doc] + start, kind="stable")  # the pieces in the order of the ids, so that these are not copied
        ends = np.concatenate([[0], np.cumsum(length[order])])
        pick = lambda x: pa.array(np.asarray(x, np.int64)[order], pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(many, part, np.int32)), pick(seq), pa.array(np.asarray(tier, np.int32)[order]), pick(rank), pick(offset),
            pa.array([keys[d] for d in doc[order]], pa.int64()), pick(start), pick(length), pick(sizes[doc]),
            pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer((4 * ends).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())]),
        ], [c.split()[0] for c in PIECES.split(", ")])

    folder = new_folder(spark, "pieces")
    rows_in = text_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows_in.mapInArrow(work, PIECES).write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    counts = pieces.where("offset = 0").groupBy("part", "tier").agg(F.count("*").alias("n")).collect()
    per_part: dict[int, int] = {}
    per_tier: dict[tuple[int, int], int] = {}
    for r in counts:
        per_part[r["part"]] = per_part.get(r["part"], 0) + r["n"]
        per_tier[r["tier"], r["part"]] = r["n"]
    first = prefix_sums(per_part)
    tier_first, before = {}, {}
    for tier, part in sorted(per_tier):
        tier_first[part, tier] = before.get(tier, 0)
        before[tier] = before.get(tier, 0) + per_tier[tier, part]
    steps = {t: -(-n * t // step_ids) for t, n in before.items()}
    step_first = prefix_sums({-t: n for t, n in steps.items()})  # long tiers first
    listed = [(p, t, first[p], tier_first[p, t], step_first[-t]) for p, t in tier_first]
    named = zip(("part", "tier", "first_sequence", "first_rank", "first_step"), zip(*listed) if listed else [()] * 5, strict=True)
    bases = spark.createDataFrame(pa.table({c: pa.array(v, pa.int32() if c in ("part", "tier") else pa.int64()) for c, v in named}))  # from a list, Spark starts further workers
    if len(listed) <= MOST_BASES:
        bases = F.broadcast(bases)  # else a join that adaptive execution may split
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_ids) / F.col("tier")))
    return pieces.join(bases, ["part", "tier"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first_sequence") + F.col("local_sequence")).alias("sequence_id"), "offset", "tier",
        (F.col("first_step") + F.floor((F.col("first_rank") + F.col("tier_rank")) / per_step)).cast("long").alias("step_group"), "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ids and, for attention masks, the length of each piece; at most `longest` ids each."""
    listed = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return pieces.groupBy("sequence_id", "tier", "step_group").agg(listed.alias("p")).select(
        "sequence_id", "tier", "step_group", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"),
        F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"))

"""Exact de-duplication against a history of digests in minimal perfect hash tables (operator 5).

Texts are equal when they are identical after lower-casing A-Z; a null text
counts as empty. The digest is the SHA-256 of that text in UTF-8. The history
is cut into shards by a hash of the digest. A shard maps its n distinct
digests to the slots 0 to n-1 by a minimal perfect hash (levels of bit arrays;
a digest that is alone at its bit of a level takes that bit's rank); a slot
holds the full digest, the locator of the winner and the number of rows. A
lookup compares all 32 bytes, so a digest that is no member is never taken for
one; such digests form groups of their own and are added.

Of equal texts the row with the largest doc_id stays. Null doc_ids lose to
all others; if a group has no other, or the winning doc_id comes in several
equal rows, one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import blocks, let_go, mix64, text_of

#: Distinct digests of a shard, about, and rows looked up by one task group.
SHARD_DIGESTS, CHUNK_ROWS = 1000, 4096
#: Shards listed as hot at most: a shard is hot from this share of all rows on.
HOT_SHARDS = 100_000
#: Bits a level has for each digest that reaches it.
GAMMA = 2
INDEX = "shard long, levels binary, bits binary, digests binary, winners binary, known binary, sizes binary"
DIGESTS = "doc_id long, digest binary"
FOUND = {"doc_id": "long", "keep_id": "long", "group_size": "long", "kept": "boolean", "text_sha256": "string"}


class PerfectHash:
    """Distinct 32-byte digests -> 0 to n-1, without a gap."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray) -> None:
        self.levels, self.bits = levels.astype(np.int64), bits
        flat = np.unpackbits(bits).astype(np.int64)
        self.flat, self.rank = flat.astype(bool), np.cumsum(flat) - flat

    @staticmethod
    def _words(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = words[:, level % 4] ^ mix64(words[:, (level + 1) % 4] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        return (mix64(seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        left, levels, bits = cls._words(digests), [], []
        while len(left):
            size = -(-GAMMA * len(left) // 8) * 8
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(np.asarray(levels, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has it. A digest that is no member may get any slot."""
        words, out = self._words(digests), np.full(len(digests), -1, np.int64)
        todo, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.levels.tolist()):
            at = base + self._at(words[todo], level, size)
            hit = self.flat[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo, base = todo[~hit], base + size
        return out


class Shard:
    """One shard of the history: the hash and its slots."""

    def __init__(self, row: dict) -> None:
        self.hash = PerfectHash(np.frombuffer(row["levels"], "<i8"), np.frombuffer(row["bits"], np.uint8))
        self.digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        self.winners = np.frombuffer(row["winners"], "<i8").copy()
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], "<i8").copy()

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot whose stored digest equals each digest in all bytes, else -1."""
        if not len(self.digests):
            return np.full(len(digests), -1, np.int64)
        slot = self.hash.slots(digests)
        same = (slot >= 0) & (self.digests[np.maximum(slot, 0)] == digests).all(1)
        return np.where(same, slot, -1)

    @staticmethod
    def row(shard: int, digests: np.ndarray, winners: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> dict:
        table = PerfectHash.of(digests)
        slot = np.argsort(table.slots(digests))
        return {"shard": shard, "levels": table.levels.astype("<i8").tobytes(), "bits": table.bits.tobytes(), "digests": digests[slot].tobytes(),
                "winners": winners[slot].astype("<i8").tobytes(), "known": known[slot].astype(np.uint8).tobytes(), "sizes": sizes[slot].astype("<i8").tobytes()}


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def digests_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and digest of every row, written once: the texts are read a single time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for block, texts in blocks(batches, 8_000_000):
            found = [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return written(text_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, DIGESTS), "digests")


class History:
    """Shards of distinct digests as a table in the shared folder."""

    def __init__(self, index: DataFrame, shards: int) -> None:
        self.index, self.shards = index, shards

    def shard(self, digest: str = "digest"):
        return F.pmod(F.xxhash64(digest), F.lit(self.shards))


def extend(history: History | None, digests: DataFrame) -> History:
    """The history with these rows: members update their slot, other digests group separately and are added."""
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))
    if history is None:
        groups = written(groups, "digest-groups")
        none = digests.sparkSession.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, INDEX.split(", "))])
        history = History(none, max(1, -(-groups.count() // SHARD_DIGESTS)))

    def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        empty = {"levels": b"", "bits": b"", "digests": b"", "winners": b"", "known": b"", "sizes": b""}
        held = Shard(old.iloc[0].to_dict() if len(old) else empty)
        found = _bytes(new["digest"])
        known = new["winner"].notna().to_numpy()
        winner, size = new["winner"].fillna(0).to_numpy().astype(np.int64), new["size"].to_numpy().astype(np.int64)
        slot = held.find(found)
        member = slot >= 0
        at = slot[member]
        held.winners[at] = np.where(known[member] & held.known[at], np.maximum(held.winners[at], winner[member]),
                                    np.where(known[member], winner[member], held.winners[at]))
        held.known[at] |= known[member]
        held.sizes[at] += size[member]
        return pd.DataFrame([Shard.row(shard, np.concatenate([held.digests, found[~member]]), np.concatenate([held.winners, winner[~member]]),
                                       np.concatenate([held.known, known[~member]]), np.concatenate([held.sizes, size[~member]]))])

    keyed = groups.select(history.shard().alias("shard"), "digest", "winner", "size")
    index = history.index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(merge, INDEX)
    return History(written(index, "digest-index"), history.shards)


def look_up(history: History, digests: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; keep_id is null and kept true where the history has no such text.

    Rows of a shard that holds a large group are dealt to several tasks by
    doc_id, each with its own copy of that shard.
    """
    rows = digests.select(history.shard().alias("shard"), "digest", "doc_id")
    per_shard = rows.groupBy("shard").agg(F.count("*").alias("n"))
    least = max(2 * CHUNK_ROWS, -(-digests.count() // HOT_SHARDS))
    hot = F.broadcast(per_shard.where(F.col("n") > least).select("shard", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1))
    rows = rows.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id", F.lit("piece")), pieces).cast("int").alias("piece"), "digest", "doc_id")
    index = history.index.join(hot, "shard", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")

    def find(table: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        if not len(probe):  # a copy of a shard for which no row was left
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in FOUND})
        digest = _bytes(probe["digest"])
        ids = probe["doc_id"]
        shard = Shard(table.iloc[0].to_dict()) if len(table) else None
        slot = shard.find(digest) if shard else np.full(len(probe), -1, np.int64)
        member = slot >= 0
        keep = pd.array([pd.NA] * len(probe), dtype="Int64")
        size = np.ones(len(probe), np.int64)
        if shard:
            at = slot[member]
            keep[member] = pd.arrays.IntegerArray(shard.winners[at], ~shard.known[at])
            size[member] = shard.sizes[at]
        values, winners = ids.fillna(-1).to_numpy().astype(np.int64), keep.to_numpy(np.int64, na_value=-1)
        best = np.where(pd.isna(keep), ids.isna().to_numpy(), ids.notna().to_numpy() & (values == winners))
        first = ~pd.DataFrame({"s": slot, "v": values, "b": best}).duplicated().to_numpy()
        return pd.DataFrame({"doc_id": ids.astype("Int64"), "keep_id": keep, "group_size": size, "kept": ~member | best & first,
                             "text_sha256": pd.Series([d.hex() for d in probe["digest"]], dtype=object)})

    return index.groupBy("shard", "piece").cogroup(rows.groupBy("shard", "piece")).applyInPandas(
        find, ", ".join(f"{c} {t}" for c, t in FOUND.items()))


def exact_dedup(docs: DataFrame, history: History | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, History]:
    """One row per document, dropped ones too, and the history that now holds all these texts."""
    digests = digests_of(docs, key, text)
    grown = extend(history, digests)
    return look_up(grown, digests), grown

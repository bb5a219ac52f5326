"""Repair of conversation structure by a run-length dynamic program (operator 12).

A conversation should read `s?(ua)+` by its roles' first letters, or be empty.
Rows are taken by turn (nulls first, ties by role, then by the text's digest).
A row's first fault counts: blank (nothing but blanks), duplicate (an earlier row
has its role and text), truncated (does not end with a stop). Blank rows and
duplicates are deleted; other rows may be kept, given another role or deleted, rows
without text may be inserted, and a truncated row that stays costs something.

The edits are a path through four states (nothing yet, after s, after u, after
a). What a row does to the states' costs is a 4 x 4 matrix under minimum and
sum, one of nine. Equal consecutive symbols are one run; a run of n rows
is n's binary powers of its matrix, which are kept. Going backwards over the runs gives the cost to
go at their ends; going forwards again, each row takes the first letter in the alphabet
whose cost fits, which makes the cheapest audit, ties to the least in ASCII.

Faults are found without texts: equal rows are counted and first occurrences
taken by partial aggregation over digests. The narrow rows are sorted over
ranges, so that a large conversation is cut, and each range gives
one row of runs per conversation. Only runs come together in one task: at most as
much as the audit, which is one cell of the result. Texts are shuffled once
and stream past their conversation's audit, in order.

Null roles and texts are one space, null turns come first and leave no gaps,
the rows of a null conversation are one conversation. Repeated rows are duplicates. Texts
of any length are read whole. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .common import parts_of

#: Blanks of a text, and stops that end one.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of edits; a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that an unrolling holds costs of at once, and symbols up to which solutions are kept.
STRETCH, KEPT_SYMBOLS = 4096, 64

#: Pairs of initials that may stand together.
LEGAL = ("su", "ua", "au")
EMPTY, S, U, A = range(4)
NEVER = 1 << 60
#: What an inserted row, or one with a new role, leads to, and its role.
AFTER = {EMPTY: U, S: U, U: A, A: U}
ROLES = {U: "user", A: "assistant"}
Matrix = tuple[tuple[int, ...], ...]


def kept(initial: str, state: int) -> int | None:
    """The state after a kept row, or None where it may not stand."""
    if initial == "s":
        return S if state == EMPTY else None
    if initial == "u":
        return U if state != U else None
    return A if initial == "a" and state == U else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def _closure() -> Matrix:
    """Costs of inserting rows between any two states."""
    one = tuple(tuple(0 if x == y else INSERT if AFTER[x] == y else NEVER for y in range(4)) for x in range(4))
    return times(one, times(one, one))


INSERTS = _closure()
#: Costs to the end of the conversation from each state.
ENDS = tuple(min(INSERTS[x][EMPTY], INSERTS[x][A]) for x in range(4))


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row: symbol d must go; s, u, a, x by initial, in capitals if truncated."""
    out = [("D", DELETE, state)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        if (to := kept(symbol.lower(), state)) is not None:
            out.append(("K", more, to))
        out.append(("R", REROLE + more, AFTER[state]))
    return out


@lru_cache(None)
def power(symbol: str, k: int) -> Matrix:
    """The matrix of 2**k rows of a symbol, each with the inserts before it."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    row = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in moves(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def back(symbol: str, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before `n` rows of a symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = tuple(min(x + c for x, c in zip(row, costs, strict=True)) for row in power(symbol, k))
    return costs


def solve(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Least cost and audit of runs (symbol, rows)."""
    ends = [ENDS]
    for symbol, n in reversed(runs):
        ends.append(back(symbol, n, ends[-1]))
    ends.reverse()  # ends[i]: costs to go before run i
    state, audit = EMPTY, []
    for i, (symbol, n) in enumerate(runs):
        done = 0
        while done < n:
            stretch = min(STRETCH, n - done)
            costs = [back(symbol, n - done - stretch, ends[i + 1])]
            for _ in range(stretch):
                costs.append(back(symbol, 1, costs[-1]))
            for before, after in zip(costs[:0:-1], costs[-2::-1], strict=True):
                state = _row(symbol, state, before, after, audit)
            done += stretch
    while ENDS[state]:
        audit.append("I")
        state = AFTER[state]
    return ends[0][EMPTY], "".join(audit)


def _row(symbol: str, state: int, before: tuple[int, ...], after: tuple[int, ...], audit: list[str]) -> int:
    """Take the least letter that reaches the cost to go, inserts first, until the row is used; the state after it."""
    while True:
        options = [(letter, cost + after[to], to, True) for letter, cost, to in moves(symbol, state)]
        options.append(("I", INSERT + before[AFTER[state]], AFTER[state], False))
        letter, _, state, used = min(o for o in options if o[1] == before[state])
        audit.append(letter)
        if used:
            return state


@lru_cache(100_000)
def solved(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """`solve`, kept for short conversations, of which many are alike."""
    return solve(runs)


def collapsed(runs: Iterator[tuple[str, int]]) -> tuple[tuple[str, int], ...]:
    out: list[tuple[str, int]] = []
    for symbol, n in runs:
        if out and out[-1][0] == symbol:
            n += out.pop()[1]
        out.append((symbol, n))
    return tuple(out)


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text with spaces for nulls, and the text's digest."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text)]
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), filled[0].alias("role"), filled[1].alias("text"),
                       F.unhex(F.sha2(filled[1], 256)).alias("digest"))


def faults(turns: DataFrame) -> DataFrame:
    """Per different row: conv, turn, role, digest, n (its repeats), initial, fault (blank, truncated or none), is_first (no earlier row is equal)."""
    core = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(core == "", "blank").when(~F.right(core, F.lit(1)).isin(*STOPS), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    narrow = turns.select("conv", "turn", "role", "digest", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
    narrow = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return narrow.join(first, same).withColumn("is_first", F.col("turn").eqNullSafe(F.col("first.turn"))).drop("c", "r", "d", "first")


def segments(rows: DataFrame) -> DataFrame:
    """One row per conversation and range of the rows of `faults`: its runs, counts and ends."""
    order = ("conv", "turn", "role", "digest")
    schema = _keyed(rows.schema["conv"], "part int, symbols string, lengths array<long>, blank long, duplicate long, truncated long, illegal long, "
                    "first string, last string, low long, high long, turns long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        for batch in batches:
            for conv, turn, initial, fault, n, is_first in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "n", "is_first")), strict=True):
                if not done or done[-1]["conv"] != conv:
                    if len(done) > 1000:
                        yield pa.RecordBatch.from_pylist(done, arrow)
                        done = []
                    one = {"conv": conv, "part": part, "symbols": "", "lengths": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial,
                           "last": None, "low": None, "high": None, "turns": 0}
                    done.append(one)
                if turn is not None and turn != one["high"]:
                    one["low"] = turn if one["low"] is None else one["low"]
                    one["high"], one["turns"] = turn, one["turns"] + 1
                one["illegal"] += n - 1 + (one["last"] is not None and one["last"] + initial not in LEGAL)
                one["last"] = initial
                late = n
                if fault != "blank" and is_first:
                    late = n - 1
                    _extend(one, initial.upper() if fault == "truncated" else initial, 1)
                    one["truncated"] += fault == "truncated"
                if late:
                    _extend(one, "d", late)
                    one["blank" if fault == "blank" else "duplicate"] += late
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    arrow = to_arrow_schema(schema)
    return rows.repartitionByRange(parts_of(rows), *order).sortWithinPartitions(*order).mapInArrow(work, schema)


def _extend(one: dict, symbol: str, n: int) -> None:
    if one["symbols"].endswith(symbol):
        one["lengths"][-1] += n
    else:
        one["symbols"] += symbol
        one["lengths"].append(n)


def _keyed(conv: T.StructField, rest: str) -> T.StructType:
    """A schema of conv, whose type is the table's own, and further columns."""
    return T.StructType([T.StructField("conv", conv.dataType), *T.StructType.fromDDL(rest).fields])


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation of `rows`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    found = segments(written(faults(_turns(rows, conv, turn, role, text)), "turns"))
    schema = _keyed(rows.schema[conv], "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    arrow = to_arrow_schema(schema)

    def one(parts: list[dict]) -> dict:
        out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
        dated = [p for p in parts if p["turns"]]
        turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
        out["gaps"] = min(dated[-1]["high"] - dated[0]["low"] + 1 - turns, (1 << 63) - 1) if dated else 0
        runs = collapsed((s, n) for p in parts for s, n in zip(p["symbols"], p["lengths"], strict=True))
        cost, audit = (solved if len(runs) <= KEPT_SYMBOLS and sum(n for _, n in runs) <= KEPT_SYMBOLS else solve)(runs)
        return out | {"conv": parts[0]["conv"], "cost": cost, "audit": audit}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    done.append(one(held))
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(done, arrow)
        if held:
            yield pa.RecordBatch.from_pylist([one(held)], arrow)

    return found.repartition(parts_of(rows), "conv").sortWithinPartitions("conv", "part").mapInArrow(work, schema)


def repaired(rows: DataFrame, audit: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: conv, place (from 0), role, text, edit (K, R or I); `audit` has conv and audit of the same rows.

    A conversation's rows come in order and in one task, which holds its audit and one batch.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    both = audit.select("conv", *none, "audit").union(_turns(rows, conv, turn, role, text).select("conv", "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit")))
    both = both.withColumn("is_row", F.col("audit").isNull())
    schema = _keyed(rows.schema[conv], "place long, role string, text string, edit string")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edits, at, place, state = None, "", 0, 0, EMPTY
        for batch in batches:
            out: list[tuple] = []

            def put(role: str, text: str, edit: str, to: int) -> None:
                nonlocal place, state
                out.append((held, place, role, text, edit))
                place, state = place + 1, to

            def inserts() -> None:
                nonlocal at
                while edits[at:at + 1] == "I":
                    put(ROLES[AFTER[state]], "", "I", AFTER[state])
                    at += 1

            for conv_, role_, text_, audit_ in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit")), strict=True):
                if audit_ is not None:
                    inserts()  # those at the end of the conversation before
                    held, edits, at, place, state = conv_, audit_, 0, 0, EMPTY
                    continue
                inserts()
                edit, at = edits[at], at + 1
                if edit == "K":
                    put(role_, text_, "K", kept(role_[:1], state))
                elif edit == "R":
                    put(ROLES[AFTER[state]], text_, "R", AFTER[state])
            yield _record(out, arrow)
        out = []
        while edits[at:at + 1] == "I":
            out.append((held, place, ROLES[AFTER[state]], "", "I"))
            at, place, state = at + 1, place + 1, AFTER[state]
        if out:
            yield _record(out, arrow)

    order = ("conv", "is_row", "turn", "role", "digest")
    dealt = both.repartition(parts_of(rows), "conv").sortWithinPartitions(*order)
    return dealt.select("conv", "role", "text", "audit").mapInArrow(work, schema)


def _record(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def digests(found: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv, sha256) of the lines `role:text` of each conversation of `repaired`, which is read as a stream.

    `in_order`: the rows come straight from `repaired`, so they need no sort.
    """
    schema = _keyed(found.schema["conv"], "sha256 string")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            out = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
                if place == 0:
                    if total is not None:
                        out.append((held, total.hexdigest()))
                    held, total = conv, hashlib.sha256()
                else:
                    total.update(b"\n")
                total.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _record(out, arrow)
        if total is not None:
            yield _record([(held, total.hexdigest())], arrow)

    sorted_ = found if in_order else found.repartition(parts_of(found), "conv").sortWithinPartitions("conv", "place")
    return sorted_.select("conv", "place", "role", "text").mapInArrow(work, schema)

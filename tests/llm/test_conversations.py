"""Operator 12 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from rowloom.llm import conversations, queries
from rowloom.session import written

BLANK = re.compile(r"[\x20\x09-\x0d]")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"


def placed(rows):
    """Rows (turn, role, text) in the operator's order, with faults."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, out = set(), []
    for t, role, text in rows:
        core = BLANK.sub("", text)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, roles of what stays) by trying every edit, as pairs of cost and audit."""

    @lru_cache(None)
    def best(j, out, inserts):  # out: the last initial so far; inserts: rows inserted since the last row
        new = "a" if out == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        options = [(0, "", ())] if j == len(rows) and out in ("", "a") else []

        def add(cost, letter, row, rest):
            options.append((cost + rest[0], letter + rest[1], row + rest[2]))

        if inserts < 3:
            add(2, "I", ((name, ""),), best(j, new, inserts + 1))
        if j < len(rows):
            _, role, text, fault = rows[j]
            add(3, "D", (), best(j + 1, out, 0))
            if fault not in ("blank", "duplicate"):
                more, first = int(fault == "truncated"), role[:1]
                if first == "s" and out == "" or first == "u" and out != "u" or first == "a" and out == "u":
                    add(more, "K", ((role, text),), best(j + 1, first, 0))
                add(2 + more, "R", ((name, text),), best(j + 1, new, 0))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def expected(rows):
    found = placed(rows)
    cost, audit, out = cheapest(tuple(found))
    turns = sorted({t for t, *_ in found if t is not None})
    initials = [r[:1] for _, r, _, _ in found]
    count = [sum(f == name for *_, f in found) for name in ("blank", "duplicate", "truncated")]
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def some(n, seed, longest=7):
    random.seed(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "ü", "s"]
    texts = ["Yes.", "No", "  ", "", None, "What? \n", "long text here!\x0b", "x\xa0", "."]
    out = []
    for conv in range(n):
        alternating = random.random() < 0.5
        for i in range(random.randint(1, longest)):
            role = ["user", "assistant"][i % 2] if alternating and random.random() < 0.8 else random.choice(roles)
            text = random.choice(texts) if random.random() < 0.7 else f"{random.random()}."
            out.append((conv, random.choice([i, i, i, 2 * i, None]), role, text))
    return out + [(None, 1, "user", "no id."), (None, None, "assistant", "none"), (None, 2, "user", "no id.")]


def by_conversation(rows):
    out = defaultdict(list)
    for c, *row in rows:
        out[c].append(tuple(row))
    return out


def results(turns, rows):
    audits = written(conversations.audits(rows), "audits")
    made = conversations.repaired(rows, audits)
    straight = {r["conv"]: r["sha256"] for r in conversations.digests(made, in_order=True).collect()}
    assert straight == {r["conv"]: r["sha256"] for r in conversations.digests(made.repartition(5)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], straight.get(r["conv"], empty)) for r in audits.collect()}


@pytest.mark.parametrize("n,seed,longest,parts", [(300, 1, 7, 8), (30, 2, 40, 23)])
def test_repair(spark, monkeypatch, n, seed, longest, parts):
    """Ranges cut conversations where there are few of them."""
    monkeypatch.setattr(conversations, "parts_of", lambda df: parts)
    rows = some(n, seed, longest)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5, F.rand(3))
    got = results(df, df)
    for conv, turns in by_conversation(rows).items():
        assert got.pop(conv) == expected(turns), (conv, placed(turns))
    assert not got


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_long_runs(monkeypatch, stretch):
    """Runs over the binary powers and stretches equal row-by-row search."""
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    random.seed(stretch)
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(60):
        runs = conversations.collapsed((random.choice("dsuaxSUAX"), random.randint(1, 9)) for _ in range(random.randint(0, 5)))
        rows = tuple((0, role[s.lower()] if s != "d" else "user", "t", "blank" if s == "d" else "truncated" if s.isupper() else None) for s, n in runs for _ in range(n))
        assert conversations.solve(runs) == cheapest(rows)[:2]


def test_one_large_conversation(spark, monkeypatch):
    """A conversation over many ranges, most of whose rows are equal, and others beside it."""
    monkeypatch.setattr(conversations, "parts_of", lambda df: 16)
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"{i}." if i % 5 else "same text.") for i in range(3000)] + [(7, 5, "user", "same text.")] * 500
    rows += some(20, 4)
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA).repartition(7)
    cut = conversations.segments(conversations.faults(conversations._turns(df, "conv_id", "turn", "role", "text"))).where("conv = 7").count()
    assert cut > 5
    got = results(df, df)[7]
    found = placed([r[1:] for r in rows if r[0] == 7])
    assert got[1:4] == tuple(sum(f == n for *_, f in found) for n in ("blank", "duplicate", "truncated"))
    runs = conversations.collapsed(("d" if f in ("blank", "duplicate") else r[0].upper() if f else r[0], 1) for _, r, _, f in found)
    assert got[5:7] == conversations.solve(runs) and len(got[6]) >= 3500


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    audits = conversations.audits(empty)
    assert audits.count() == 0 and conversations.repaired(empty, audits).count() == 0


def test_query(spark, monkeypatch):
    """The contract's damage, with conversations that it leaves empty."""
    rows = some(400, 9, 4) + [(c, t, "user", "Twice. Or? \t") for c in range(1000, 1100) for t in (0, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(queries, "_read", lambda spark, folder, name: table)
    left = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        left[c] += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = queries.op12_conversation_repair(spark, "").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {c: expected(turns) for c, turns in left.items()}
    assert any(not turns for turns in left.values())

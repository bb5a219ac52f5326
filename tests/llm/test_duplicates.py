"""Operators 5 and 6 against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import exact, links, neardup

from odd_rows import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_perfect_hash_is_minimal_and_byte_checked():
    made = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    table = exact.PerfectHash.of(made[:3000])
    assert sorted(table.slots(made[:3000])) == list(range(3000))
    n = np.zeros(3000, np.int64)
    shard = exact.Shard(exact.Shard.row(0, made[:3000], n, n == 0, n))
    assert (shard.find(made[:3000]) >= 0).all() and (shard.find(made[3000:]) == -1).all()


def expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return collections.Counter((i, keep[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [(t or "").translate(LOWER)])


@pytest.mark.parametrize("chunk", [2, 4096])
def test_exact_dedup(docs, monkeypatch, chunk):
    monkeypatch.setattr(exact, "CHUNK_ROWS", chunk)
    rows = [*ODD, *[(100 + i, "copy me") for i in range(40)]]
    got = exact.exact_dedup(docs(*rows))[0].collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_history_grows_with_each_batch(docs):
    first, second = [(1, "a"), (2, "b"), (9, "B")], [(3, "A"), (4, "c"), (5, "C"), (6, None)]
    _, history = exact.exact_dedup(docs(*first))
    got, history = exact.exact_dedup(docs(*second), history)
    want = {(i, k, n) for i, k, n, _ in expected([*first, *second])}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {w for w in want if w[0] in {i for i, _ in second}}
    assert {(r.doc_id, r.kept) for r in exact.look_up(history, exact.digests_of(docs(*first))).collect()} == {(1, False), (2, False), (9, True)}
    assert [r.kept for r in exact.look_up(history, exact.digests_of(docs((7, "new")))).collect()] == [True]


def test_exact_dedup_of_nothing(docs):
    assert exact.exact_dedup(docs())[0].count() == 0


def brute(rows):
    def words(t):
        return (t or "").translate(LOWER).replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")

    sets = []
    for _, t in rows:
        w = [x for x in words(t) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return collections.Counter((i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(rows))


def near_rows(seed, groups, size):
    draw = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(8, 120))]
        for _ in range(draw.randint(1, size)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 30))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(50)}"
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("small, deepest", [(256, 10), (4, 10), (4, 1), (3, 2)])
def test_near_dedup(docs, monkeypatch, small, deepest):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "DEEPEST", deepest)
    monkeypatch.setattr(neardup, "MEDIUM", 2 * small)
    monkeypatch.setattr(neardup, "BLOCK", 2 * small)
    odd = [(i if i is None else 10_000 + i, t) for i, t in ODD if (i, t) != (6, ODD[6][1])]
    rows = [*near_rows(small, 12, 14), *odd]
    got = neardup.near_dedup(docs(*rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minwise_tokens_estimate_the_share_of_common_elements():
    draw = np.random.default_rng(2)
    off = []
    for n in (3, 40, 400, 5000):
        for _ in range(20):
            pool = np.unique(draw.integers(0, 1 << 63, 8 * n).astype(np.uint64) * np.uint64(2) + np.uint64(1))[:2 * n]
            draw.shuffle(pool)
            a, b = pool[:n], pool[n // 4:n // 4 + n]
            tokens = neardup.minwise([np.sort(a), np.sort(b)])
            low = (tokens * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            common = len(np.intersect1d(a, b))
            off.append((tokens[0] == tokens[1]).mean() - common / (2 * n - common))
            assert neardup.resemblance(low[:1], low[1])[0] == (low[0] == low[1]).mean() >= (tokens[0] == tokens[1]).mean()
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04  # of independent tokens: 0.031


def test_texts_of_some_hundred_open_members_are_sent_once(docs, spark):
    """Sets that resemble each other without links, and one pair that is linked."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(600):
        copy = list(base)
        for at in range(draw.randrange(20), 300, 20):
            copy[at] = f"x{draw.randrange(10**9)}"
        texts.append(" ".join(copy))
    texts.append(texts[-1] + " more")
    rows = docs(*enumerate(texts)).select("doc_id", "text")
    sets = neardup.written(neardup.sets_of(rows).drop("digest"), "sets")
    members = sets.select(F.lit(1).cast("long").alias("branch"), "key", F.col("key").alias("label"))
    sent = []
    own = neardup.with_texts
    neardup.with_texts = lambda needs, docs: (sent.append(needs.count()), own(needs, docs))[1]
    try:
        found = neardup.joining_links(members, rows, sets).collect()
    finally:
        neardup.with_texts = own
    ids = {r.key: r.doc_id for r in sets.collect()}
    full = [neardup.shingles(t) for t in texts]
    want = {(a, b) for a in range(601) for b in range(a) if neardup.are_linked(full[a], full[b])}
    parent = list(range(601))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[top(a)] = top(b)
    components = len({top(x) for x in range(601)})
    got = {tuple(sorted((ids[r.a], ids[r.b]), reverse=True)) for r in found}
    assert (600, 599) in got and got <= want and len(got) == len(found) == 601 - components
    assert sent == [601]


def test_near_dedup_of_nothing_and_without_links(docs):
    assert neardup.near_dedup(docs()).count() == 0
    got = neardup.near_dedup(docs((1, "a b c"), (2, "d e f"), (3, None))).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_components_by_brute_force(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    got = {(r.node, r.label) for r in links.components(spark.createDataFrame(edges, "a long, b long").withColumn("x", F.lit(1))).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == set(label.items())

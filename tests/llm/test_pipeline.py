"""The pipeline's duplicate stages against brute force, with documents that share an id."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from rowloom.session import _folders

from odd_rows import ODD
from test_duplicates import LOWER, near_rows


def shared_ids(rows, seed):
    """The rows under few ids, with repeated rows and null ids."""
    draw = random.Random(seed)
    out = [(draw.choice([None, *range(len(rows) // 2)]), t) for _, t in rows]
    return out + draw.choices(out, k=len(out) // 4)


def kept(stage, docs, rows):
    table = docs(*rows)
    out = stage(table.sparkSession, table, "")
    assert out.columns == table.columns
    return collections.Counter((r.doc_id, r.text) for r in out.collect())


def test_exact_stage(docs):
    """Of equal texts the row with the largest id stays, once, and only that one."""
    rows = [(5, "alpha beta gamma"), (9, "Alpha beta gamma"), (5, "other words"), (5, "other words"), (None, "only null"), (None, "only null"), (None, "other words"), *ODD]
    rows += shared_ids(near_rows(1, 6, 5), 1)
    best = {}
    for i, t in rows:
        k = (t or "").translate(LOWER)
        best[k] = i if k not in best else max((x for x in (i, best[k]) if x is not None), default=None)
    got = kept(corpus_pipeline.exact_copies, docs, rows)
    assert collections.Counter((i, (t or "").translate(LOWER)) for i, t in got.elements()) == collections.Counter((i, k) for k, i in best.items())
    assert set(got) <= set(rows)


def test_near_stage(docs):
    """Of each group one row stays: the smallest id, of several texts of that id the one with the least digest; rows without words stay."""
    rows = sorted(set(shared_ids(near_rows(2, 8, 8), 2)), key=str) + [(3, ""), (3, " "), (None, "\n"), (None, None), (4, "a b"), (4, "A  b")]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").translate(LOWER).split() for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = lambda i, t: (i is None, i or 0, hashlib.sha256((t or "").encode()).digest())
    first = {}
    for g, (i, t), s in zip(group, rows, sets, strict=True):
        if s and (g not in first or order(i, t) < order(*first[g])):
            first[g] = (i, t)
    want = collections.Counter(first.values()) + collections.Counter(r for r, s in zip(rows, sets, strict=True) if not s)
    assert kept(corpus_pipeline.near_copies, docs, rows) == want


@pytest.mark.parametrize("most", [1 << 6, 1 << 25])
def test_a_full_table_of_bits_changes_nothing(docs, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "LEAST_SLOTS", 64)
    monkeypatch.setattr(corpus_pipeline, "MOST_SLOTS", most)
    rows = [(i, f"text {i // 2}") for i in range(400)]
    assert kept(corpus_pipeline.exact_copies, docs, rows) == collections.Counter((i, t) for i, t in rows if i % 2)


def test_only_the_decisions_stay_on_disk(spark, docs):
    before = list(_folders)
    corpus_pipeline.exact_copies(spark, docs((1, "a"), (2, "a"), (3, "b")), "").collect()
    assert [f.rsplit("/", 1)[1].split("-")[0] for f in _folders if f not in before] == ["marks"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, stage):
    table = docs()
    assert stage(spark, table, "").count() == 0

"""Operator 13: the machine against plain sums and slopes, and its held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from rowloom.llm import quality, queries

from odd_rows import ODD

SF = "/root/testdata/sf0.01"


def test_linear_time_score_is_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), np.zeros((1, 1)))
    for n in (0, 1, 2, 9):
        places, values = rng.permutation(50)[:n], rng.normal(size=n) / 3
        z = 0.3 + sum(machine.weights[p] * v for p, v in zip(places, values, strict=True))
        z += sum(machine.vectors[places[i]] @ machine.vectors[places[j]] * values[i] * values[j] for i in range(n) for j in range(i))
        assert machine.score(places, values) == pytest.approx(1 / (1 + np.exp(-z)))


def test_interactions_are_learnt():
    """Words that are good alone and bad together: no linear score tells them apart."""
    random.seed(5)
    texts = [" ".join([w for w in ("red", "blue") if random.random() < 0.5] + [f"w{random.randint(0, 9)}"]) for _ in range(800)]
    labels = np.array([("red" in t) != ("blue" in t) for t in texts], np.float32)
    rows = [quality.features(t) for t in texts]
    rows = [(np.zeros_like(s), b, a) for s, b, a in rows]
    machine = quality.train(rows[:600], labels[:600], np.ones(600, np.float32))
    right = [(machine.score(*machine.row(*r)) >= 0.5) == bool(y) for r, y in zip(rows[600:], labels[600:], strict=True)]
    assert np.mean(right) > 0.95


def test_features_do_not_depend_on_kept_words(monkeypatch):
    texts = ["One two, two!! 3x", "", " \n ", "x" * 5000 + " y", "a\na\nb", "é É ß"] * 2
    want = [quality.features(t, 4) for t in texts]
    monkeypatch.setattr(quality, "KEPT_WORDS", 2)
    for (a, b, c), (d, e, f) in zip(want, (quality.features(t, 4) for t in texts), strict=True):
        assert (a == d).all() and (b == e).all() and (c == f).all()
    assert len(want[0][0]) == len(quality.STATISTICS) and np.isfinite([w[0] for w in want]).all()


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out(spark):
    out = queries.op13_quality(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    both = out[out["held_out"]].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 50 and auc(both["score"].to_numpy(), both["quality"].to_numpy()) > 0.9
    assert (both["predicted"] == both["quality"]).mean() > 0.9


def test_held_out_labels_are_not_learnt(spark, docs):
    rows = [(i, "good text here." if i % 3 else "bad $$$ &&&") for i in range(200)]
    marks = [(i, 1 if i % 3 else 0) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    scores = []
    for some in (marks, turned):
        labels = spark.createDataFrame(some, "doc_id long, quality int")
        scores.append({r["doc_id"]: r["score"] for r in quality.score(docs(*rows), labels, fit_rows=100).collect()})
    assert scores[0] == scores[1]
    assert all((scores[0][i] > 0.5) == (q == 1) for i, q in marks)


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(5, 1), (5, None), (6, 0), (7, 0), (7, 1), (None, 0), (99, 1), (8, 1)], "doc_id long, quality int")
    table = docs(*ODD, *[(5, "password: ABC def")] * 30)
    out = quality.score(table, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    found = out.collect()
    assert len(found) == len(ODD) + 30 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) <= 2
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(table, none).collect()} == {0.5}
    assert quality.score(docs(), labels).count() == 0
    assert quality.score(table.drop("n_chars"), labels).count() == len(found)

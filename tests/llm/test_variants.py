"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.llm import queries, variants

from odd_rows import ODD


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n, ratio):
    forms, out = {}, set()
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            forms[w] = best
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n[w], len(near[w]), n[forms[w]] if w in forms else None))
    return out


def got(df):
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("letters,ratio,parts", [("ab", 2, 1), ("abé\U0001f600", 3, 7), ("aA-", 5, 30)])
def test_group_variants(spark, monkeypatch, letters, ratio, parts):
    monkeypatch.setattr(variants, "parts_of", lambda df: parts)
    random.seed(parts)
    words = {"".join(random.choices(letters, k=random.randint(0, 6))): int(5 ** random.uniform(0, 6)) for _ in range(250)}
    rows = [(w, n, "x") for w, n in words.items()] + [(None, 9, "x"), ("zz", None, "x")]
    df = spark.createDataFrame(rows, "word string, n long, path string").repartition(3)
    assert got(variants.group_variants(df, ratio)) == brute(words, ratio)


def test_repeated_and_long_words(spark):
    long = "ab" * 10_000
    rows = [("word", 2), ("word", 3), ("wort", 1), ("wor", 30), (long, 1), (long + "b", 40), (long[:5000] + long[5001:], 7)]
    df = spark.createDataFrame(rows, "word string, n int")
    want = Counter()
    for w, n in rows:
        want[w] += n
    assert got(variants.group_variants(df)) == brute(want, 5)


def test_no_words(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_a_chain_of_forms(spark):
    words = {"a" * (i + 1): 2 ** i for i in range(12)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    out = got(variants.group_variants(df, 2))
    assert out == brute(words, 2) and {r[2] for r in out} == {"a" * 12}


@pytest.mark.parametrize("a,b,n", [("", "", 0), ("", "abc", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("abc", "abcd", 3), ("xbc", "abc", 0)])
def test_shared_prefix(a, b, n):
    assert variants.shared(a, b) == n


def test_query_words(spark, docs, monkeypatch):
    """The contract's words, from texts with rare letters, nulls and repeated rows."""
    random.seed(3)
    base = ["mountain", "Mountain", "MOUNTAINS", "ÉCOLE", "écoles", "naïveté", "xyz", "straße", "a×b÷cde"]
    rows = [(i, " ".join(random.choices(base, k=60)) + "?x_" + random.choice(base)) for i in range(60)] + [*ODD, (None, "mountain " * 6)]
    table = docs(*rows)
    monkeypatch.setattr(queries, "_read", lambda spark, folder, name: table)
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = brute({w: c for w, c in n.items() if len(w) >= 6 and c >= 5}, 5)
    out = queries.op11_spelling_variants(spark, "")
    assert got(out) == want and any(r[1] for r in want)
    assert dict(out.dtypes)["n_near"] == "bigint" and out.where(F.col("form").isNull()).where("form_n IS NOT NULL").isEmpty()

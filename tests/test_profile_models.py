import math

import pytest

import rowloom as rl


@pytest.mark.parametrize("parts", [1, 8])
def test_field_summary(rows, parts):
    df = rows("a string, b int, c boolean", ("1", 5, True), ("x", None, False), (None, 7, None), ("4.5", 6, True), parts=parts)
    assert rows.out(df.transform(rl.field_summary())) == [
        ("a", 4, 1, 1.0, 4.5, 2.75), ("b", 4, 1, 5.0, 7.0, 6.0), ("c", 4, 1, None, None, None)]
    empty = df.limit(0).transform(rl.field_summary("b"))
    assert rows.out(empty) == [("b", 0, 0, None, None, None)]


def test_frequency_table(rows):
    df = rows("v string", ("a",), ("b",), ("a",), (None,), ("a",), ("b",))
    out = df.transform(rl.frequency_table("v"))
    assert [tuple(r) for r in out.collect()] == [("a", 3, 50.0), ("b", 2, 33.33), (None, 1, 16.67)]
    with pytest.raises(ValueError):
        rl.frequency_table("")


def test_correlation(rows):
    df = rows("x double, y double, k double, t string", (1.0, 2.0, 1.0, "3"), (2.0, 4.0, 1.0, "1"), (3.0, 6.0, 1.0, "x"), (9.0, None, 1.0, None))
    out = rows.out(df.transform(rl.correlation()))
    assert out == [("x", "k", 0.0), ("x", "y", 1.0), ("y", "k", 0.0)]
    assert rows.out(df.transform(rl.correlation("x,t"))) == [("x", "t", -1.0)]
    with pytest.raises(ValueError):
        df.transform(rl.correlation("x"))


def test_correlation_in_several_passes(rows, monkeypatch):
    from rowloom.operators import profile
    df = rows("a double, b double, c double", (1.0, 2.0, 3.0), (2.0, 1.0, 3.5), (3.0, 5.0, 1.0))
    whole = rows.out(df.transform(rl.correlation()))
    monkeypatch.setattr(profile, "PAIRS_PER_PASS", 2)
    assert rows.out(df.transform(rl.correlation())) == whole


@pytest.mark.parametrize("parts", [1, 8])
def test_regression(rows, parts):
    df = rows("x string, y double", ("1", 3.0), ("2", 5.0), ("3", 7.0), ("bad", 1.0), ("4", None), parts=parts)
    got = {r.x: r for r in df.transform(rl.regression("x", "y")).collect()}
    assert got["4"].predicted == pytest.approx(9.0) and got["bad"].predicted is None
    assert got["1"].slope == pytest.approx(2.0) and got["1"].intercept == pytest.approx(1.0) and got["1"].r2 == pytest.approx(1.0)
    text = df.transform(rl.regression("x", "y", as_text=True)).first()
    assert (text.slope, text.intercept, text.r2) == ("2.000000", "1.000000", "1.0000")
    assert rows("x string, y string", ("a", "b")).transform(rl.regression("x", "y")).count() == 0
    flat = rows("x double, y double", (1.0, 4.0), (2.0, 4.0)).transform(rl.regression("x", "y")).first()
    assert flat.r2 == 1.0 and flat.slope == 0.0


def classify(train, row):
    """The rule in plain Python."""
    classes = {}
    for *x, c in train:
        classes.setdefault(c, []).append(x)
    best = None
    for c, xs in classes.items():
        score = math.log(len(xs) / len(train))
        for i, v in enumerate(row):
            mean = sum(x[i] for x in xs) / len(xs)
            var = max(sum(x[i] ** 2 for x in xs) / len(xs) - mean ** 2, 1e-9)
            score += -0.5 * math.log(2 * math.pi * var) - (v - mean) ** 2 / (2 * var)
        if best is None or score > best[0]:
            best = (score, c)
    return best[1]


@pytest.mark.parametrize("block", [64, 1])
def test_naive_bayes(rows, monkeypatch, block):
    from rowloom.operators import models
    monkeypatch.setattr(models, "CLASSES_PER_EXPRESSION", block)
    data = [(float(i % 10) + 5 * c, float((i * 7) % 11) - c, f"c{c}") for i in range(40) for c in range(3)]
    df = rows("a double, b double, label string", *data, parts=4)
    out = df.transform(rl.naive_bayes("a,b", "label"))
    assert out.columns == ["a", "b", "label", "predicted_class"] and out.count() == len(data)
    for r in out.distinct().collect():
        assert r.predicted_class == classify(data, (r.a, r.b))
    empty = df.limit(0).transform(rl.naive_bayes("a,b", "label"))
    assert empty.count() == 0 and "predicted_class" in empty.columns
    with pytest.raises(ValueError):
        rl.naive_bayes("", "label")


@pytest.mark.parametrize("classes, features, rows_of_class, digits, odd", [
    (2000, 1, 20, 1, False), (2000, 1, 2, 0, True), (300, 2, 5, 1, True), (400, 4, 3, 0, False), (3000, 1, 1, 0, False)])
def test_an_index_gives_what_scoring_all_classes_gives(classes, features, rows_of_class, digits, odd):
    import numpy as np
    from rowloom.operators.envelope import Classes
    draw = np.random.default_rng(classes + features)
    values = draw.exponential(50, (features, classes, rows_of_class)).round(digits)
    mean, var = values.mean(2), np.maximum(values.var(2), 1e-9)
    mean[:, 1::5], var[:, 1::5] = mean[:, :-1:5], var[:, :-1:5]  # equal classes: the greatest counts
    constant = np.log(draw.integers(1, 4, classes) / classes) - 0.5 * np.log(2 * np.pi * var).sum(0)
    x = values.reshape(features, -1)[:, :1500].copy()
    low, high = x.min(1), x.max(1)
    if odd:
        x[0, :6] = np.nan, np.inf, -np.inf, 1e200, high[0] + 1, -1e300
        var[0, 7], constant[7] = np.inf, -np.inf
    index = Classes(mean, var, constant, low, high)
    for _ in range(2):
        score, at = index.best(x)
        with np.errstate(all="ignore"):
            all_scores, last = index._scan(x, np.arange(classes))
        assert score.tolist() == all_scores.tolist() and at.tolist() == last.tolist()
        mean[0, 9] = var[0, 9] = constant[9] = np.nan  # then that class is the best one everywhere
        index = Classes(mean, var, constant, low, high)


def test_few_of_many_classes_are_scored(spark, monkeypatch):
    """30,000 classes of 4 rows: without an index 3.6 thousand million scores."""
    import numpy as np
    from pyspark.sql import functions as F
    from rowloom.operators import models
    made = []
    kept = models._best_class
    monkeypatch.setattr(models, "_best_class", lambda *a: made.append(a) or kept(*a))
    df = spark.range(0, 120_000, 1, 8).select((F.col("id") % 30_000).alias("c"), F.round(-50 * F.log1p(-F.rand(3)), 2).alias("x")).localCheckpoint()
    out = df.transform(rl.naive_bayes("x", "c", "likely"))
    model, total, low, high = made[0][:4]
    assert out.count() == 120_000
    mean, var, n = (model.column(c).to_numpy() for c in ("mean0", "var0", "n"))
    constant = np.log(n / total) - 0.5 * np.log(2 * np.pi * var)
    for r in out.orderBy("c", "x").limit(300).collect():
        score = constant - (r.x - mean) ** 2 / (2 * var)
        assert score[r.likely] == pytest.approx(score.max(), rel=1e-12)
    from rowloom.operators.envelope import Classes
    index = Classes(mean[None], var[None], constant, low, high)
    assert index.size.max() < 200 and index.size.sum() < 60_000

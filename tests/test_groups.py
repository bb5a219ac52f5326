import statistics
import random

import pytest

import rowloom as rl


def test_aggregate(rows):
    df = rows("region string, amount string, id string", ("Nord", "100", "1"), ("Nord", "200", "2"), ("Sud", "150", None), ("Sud", "x", "9"))
    out = df.transform(rl.aggregate("region", "SUM(amount),COUNT(id),AVG(amount),MIN(amount),MAX(amount),junk"))
    assert rows.out(out) == [("Nord", 300.0, 2, 150.0, 100.0, 200.0), ("Sud", 150.0, 2, 75.0, 0.0, 150.0)]
    assert out.columns[1:3] == ["SUM_amount", "COUNT_id"]
    skip = df.transform(rl.aggregate("region", "AVG(amount)", non_numeric="null"))
    assert rows.out(skip) == [("Nord", 150.0), ("Sud", 150.0)]
    for wrong in ("MODE(amount)", "junk", ""):
        with pytest.raises(ValueError):
            rl.aggregate("region", wrong)
    with pytest.raises(ValueError):
        rl.aggregate("", "SUM(amount)")


@pytest.mark.parametrize("parts", [1, 8])
def test_groupby(rows, parts):
    df = rows("o int, g string, v string, c string", (1, "X", "1", "p"), (2, "X", "3", None), (3, "X", "5", "p"), (4, "Y", "7", ""),
              (5, "", "9", "z"), (6, None, "9", "z"), parts=parts)
    spec = "SUM(v) AS s, COUNT(c) as n, FIRST(c), LAST(c) AS l, MEDIAN(v) AS m, NUNIQUE(c) AS u, STD(v) AS sd, VAR(v) AS var"
    out = df.transform(rl.groupby("g", spec, order_by="o"))
    assert out.columns == ["g", "s", "n", "FIRST_c", "l", "m", "u", "sd", "var"]
    assert [tuple(r) for r in out.collect()] == [("X", 9.0, 2, "p", "p", 3.0, 2, 2.0, 4.0), ("Y", 7.0, 0, "", "", 7.0, 1, 0.0, 0.0)]
    down = df.transform(rl.groupby("g", "FIRST(v) AS f", order_by="o desc"))
    assert rows.out(down) == [("X", "5"), ("Y", "7")]
    assert df.transform(rl.groupby("g", "SUM(v)", dropna=False)).count() == 4
    assert df.transform(rl.groupby("g", "SUM(v) AS s", as_index=False)).columns == ["s"]
    with pytest.raises(ValueError):
        rl.groupby("g", "INVALID(y)")
    with pytest.raises(ValueError):
        rl.groupby("g", "FIRST(v)")


@pytest.mark.parametrize("parts", [1, 8])
def test_ranged_median_equals_plain(rows, parts):
    data = [(k, k2, float((i * 37) % 91)) for i in range(300) for k, k2 in [("hot" if i % 3 else f"g{i % 7}", None if i % 2 else "a")]]
    df = rows("k string, k2 string, v double", *data, parts=parts)
    plain = df.transform(rl.groupby("k,k2", "MEDIAN(v) AS m, COUNT(v) AS n", dropna=False))
    ranged = df.transform(rl.groupby("k,k2", "MEDIAN(v) AS m, COUNT(v) AS n", dropna=False, median_values=3))
    assert rows.out(plain) == rows.out(ranged)
    expected = {}
    for k, k2, v in data:
        expected.setdefault((k, k2), []).append(v)
    assert {(r.k, r.k2): r.m for r in ranged.collect()} == {k: statistics.median(v) for k, v in expected.items()}
    alone = df.transform(rl.groupby("k", "MEDIAN(v) AS m", median_values=3))
    assert alone.columns == ["k", "m"]


def test_pivot(rows):
    df = rows("region string, product string, amount string", ("Nord", "A", "100"), ("Nord", "B", "200"), ("Sud", "A", "150"), ("Nord", "A", "50"))
    out = df.transform(rl.pivot("region", "product", "amount"))
    assert out.columns == ["region", "A", "B"]
    assert rows.out(out) == [("Nord", 150.0, 200.0), ("Sud", 150.0, 0.0)]
    counts = df.transform(rl.pivot("region", "product", "amount", "COUNT", values=["B", "C"]))
    assert rows.out(counts) == [("Nord", 1, 0), ("Sud", 0, 0)]
    with pytest.raises(ValueError):
        rl.pivot("region", "product", "amount", "MODE")


def test_pivot_then_unpivot(rows):
    df = rows("g string, p string, v double", ("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("b", "y", 4.0))
    back = df.transform(rl.pivot("g", "p", "v")).transform(rl.unpivot("x,y", "p", "v"))
    assert rows.out(back) == rows.out(df)


def test_unpivot(rows):
    df = rows("region string, jan int, fev int, mar string", ("N", 1, None, "z"))
    out = df.transform(rl.unpivot("jan,fev,mar", "mois", "montant"))
    assert rows.out(out) == [("N", "fev", None), ("N", "jan", "1"), ("N", "mar", "z")]
    assert df.transform(rl.unpivot(["jan", "fev"])).dtypes[-1] == ("value", "int")
    with pytest.raises(ValueError):
        df.transform(rl.unpivot("jan,nope"))
    with pytest.raises(ValueError):
        df.transform(rl.unpivot("jan", "region"))


@pytest.mark.parametrize("few", [1, 20])
def test_medians_of_any_distribution(rows, monkeypatch, few):
    """Several medians at once over values of all sizes, infinities, NaN and ties; no value is lost between bins."""
    from rowloom.operators import groups
    monkeypatch.setattr(groups, "MEDIAN_FEW", few)
    monkeypatch.setattr(groups, "MEDIAN_BINS", 8)
    rng = random.Random(few)
    wild = [0.0, -0.0, 5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002]
    data = [("w", rng.choice(wild), 1e9 + i) for i in range(60)] + [("e", 10.0 ** rng.uniform(-300, 300), 7.0) for _ in range(81)]
    data += [("n", float("nan") if i % 3 else 1.0 * i, float(i)) for i in range(31)] + [("one", 3.0, None), ("two", 1.0, 2.0), ("two", 2.0, 4.0)]
    df = rows("k string, a double, b double", *data, parts=5)
    step = lambda n: rl.groupby("k", "MEDIAN(a) AS ma, MEDIAN(b) AS mb, SUM(b) AS s", non_numeric="null", median_values=n)
    got, want = ([(r.k, str(r.ma), str(r.mb), r.s) for r in df.transform(step(n)).collect()] for n in (2, 10 ** 6))
    assert got == want


def test_ranged_medians_write_no_values(rows):
    df = rows("k int, v double", *[(1, float(i)) for i in range(5000)], parts=4)
    plan = df.transform(rl.groupby("k", "MEDIAN(v) AS m", median_values=10))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "RepartitionByExpression" not in plan

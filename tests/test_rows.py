import pytest

import rowloom as rl
from rowloom.plans.checks import plan_of


@pytest.mark.parametrize("condition, expected", [
    ("amount > 100", 2), ("amount >= 150", 2), ("amount < 51", 1), ("amount <= 50", 1), ("amount == 200", 1),
    ("amount != 200", 2), ("country == 'FR'", 2), ('country != "FR"', 1), ("n > 1", 2), ("n > 1.5", 2),
])
def test_filter(rows, condition, expected):
    df = rows("amount string, country string, n int", ("150", "FR", 1), ("50", "DE", 2), ("200", "FR", 3))
    assert df.transform(rl.filter_rows(condition)).count() == expected


def test_filter_errors_and_nulls(rows):
    df = rows("t string, x double", ("abc", 1.0), (None, None), ("FR", float("nan")))
    with pytest.raises(ValueError):
        rl.filter_rows(" ")
    for wrong in ("t", "t > 'a'", "t > b", "missing > 1"):
        with pytest.raises(ValueError):
            df.transform(rl.filter_rows(wrong))
    with pytest.raises(Exception, match="number"):
        df.transform(rl.filter_rows("t > 1")).collect()
    assert df.transform(rl.filter_rows("t != 'FR'")).count() == 2
    assert df.transform(rl.filter_rows("x > 0")).count() == 1


def test_filter_literals(rows):
    import decimal
    df = rows("n int, d decimal(10,2)", (1, decimal.Decimal("1.10")), (2, decimal.Decimal("2.50")), (None, None))
    assert df.transform(rl.filter_rows("d >= 2.5")).count() == 1
    assert df.transform(rl.filter_rows("d == 1.1")).count() == 1
    assert df.transform(rl.filter_rows("n < inf")).count() == 2
    assert df.transform(rl.filter_rows("d < 1e30")).count() == 2


def test_filter_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2.0d as x", "'a' as s", "1 as unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.transform(rl.filter_rows("id > 3")).transform(rl.filter_rows("x <= 10.5")).transform(
        rl.filter_rows("s == 'a'")).select("id")
    plan = plan_of(plan)
    assert "GreaterThan(id,3)" in plan and "LessThanOrEqual(x,10.5)" in plan and "EqualTo(s,a)" in plan
    assert "unused" not in plan.split("ReadSchema:")[-1]


@pytest.mark.parametrize("field, operator, value, kind, expected", [
    ("s", "eq", "ab", "string", 1), ("s", "neq", "ab", "string", 2), ("s", "contains", "b", "string", 2),
    ("s", "not_contains", "b", "string", 1), ("s", "starts_with", "a", "string", 1), ("s", "ends_with", "c", "string", 2),
    ("s", "gt", "ab", "string", 2), ("s", "lt", "bc", "string", 1), ("s", "is_null", "", "string", 1),
    ("s", "is_not_null", "", "string", 3), ("n", "eq", "2", "number", 1), ("n", "neq", "2", "number", 2),
    ("n", "gt", "1", "number", 2), ("n", "gte", "2", "number", 2), ("n", "lt", "2", "number", 1), ("n", "lte", "2.0", "number", 2),
    ("b", "is_true", "", "bool", 2), ("b", "eq", "false", "bool", 2), ("b", "is_false", "", "bool", 1), ("t", "gt", "9", "number", 2),
])
def test_filter_advanced(rows, field, operator, value, kind, expected):
    df = rows("s string, n int, b string, t string", ("ab", 1, " true ", "10 "), ("bc", 2, "1", "9"), ("c", 3, "f", "11"), (None, None, None, None))
    yes, no = rl.filter_advanced(df, field, operator, value, kind)
    assert (yes.count(), no.count()) == (expected, 4 - expected)


def test_filter_advanced_errors(rows):
    df = rows("s string", ("x",))
    for operator, kind in (("gte", "string"), ("contains", "number"), ("gt", "bool"), ("like", "string"), ("eq", "date")):
        with pytest.raises(ValueError):
            rl.filter_advanced(df, "s", operator, "1", kind)
    with pytest.raises(Exception, match="number"):
        rl.filter_advanced(df, "s", "gt", "1", "number")[0].collect()


def test_filter_rules(rows):
    df = rows("a int, b string", (9, "x"), (10, "y"), (None, "z"))
    assert rows.out(df.transform(rl.filter_rules([("a", "gt", "5")])), "a") == [(9,)]
    assert rows.out(df.transform(rl.filter_rules([("a", "gt", 5)], compare_as="number")), "a") == [(10,), (9,)]
    assert df.transform(rl.filter_rules([("b", "neq", "x"), ("a", "lt", "2")])).count() == 1
    assert df.transform(rl.filter_rules([("nope", "eq", "x")])).count() == 0
    with pytest.raises(ValueError):
        rl.filter_rules([("a", "gte", 1)])


def test_split(rows):
    df = rows("amount string", ("1500",), ("700",), ("100",))
    assert [d.count() for d in rl.split(df, "amount > 1000, amount > 500", 3)] == [1, 1, 1]
    assert [d.count() for d in rl.split(df, ["amount > 5000"], 2)] == [0, 3]
    assert sorted(r._route for r in df.transform(rl.route("amount > 1000,amount > 500")).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        rl.split(df, "amount > 1", 3)


def test_chain_fork_dummy(rows):
    df = rows("a int", (1,), (2,))
    assert df.transform(rl.chain(rl.filter_rows("a > 1"), rl.rename("a:b"))).columns == ["b"]
    assert [d.count() for d in rl.fork(rl.dummy(df), 3)] == [2, 2, 2]


@pytest.mark.parametrize("parts", [1, 8])
def test_drop_duplicates(rows, parts):
    df = rows("ord int, id string, val string", (1, "1", "A"), (2, "1", "B"), (3, "2", "C"), (4, None, "D"), parts=parts)
    keep = lambda k: rows.out(df.transform(rl.drop_duplicates("id", k, order_by="ord")), "val")
    assert keep("first") == [("A",), ("C",), ("D",)]
    assert keep("last") == [("B",), ("C",), ("D",)]
    assert keep(False) == [("C",), ("D",)]
    indexed = df.transform(rl.drop_duplicates("id", "first", order_by="ord", ignore_index=True))
    assert rows.out(indexed, "_index", "val") == [(0, "A"), (1, "C"), (2, "D")]
    with pytest.raises(ValueError):
        rl.drop_duplicates("id", "middle")


def test_dedup(rows):
    df = rows("id int, country string, val int", (1, "FR", 1), (1, "FR", 2), (2, "FR", 3))
    assert df.transform(rl.dedup("id,country")).count() == 2
    assert rows.out(df.transform(rl.dedup(["id"], order_by="val")), "val") == [(1,), (3,)]
    assert rows("a int, b string", (1, "X"), (1, "X"), (1, "Y")).transform(rl.dedup()).count() == 2
    assert rows("a int, b string", (1, "X"), (1, "X"), (1, "Y")).transform(rl.drop_duplicates(keep=False)).count() == 1


def test_hot_key_is_cut_before_the_shuffle(rows):
    df = rows("ord int, id int", (1, 1), (2, 1))
    plan = plan_of(df.transform(rl.drop_duplicates("id", order_by="ord")))
    assert "WindowGroupLimit" in plan


def test_sort(rows):
    df = rows("amount string, id int", ("300", 1), ("100", 2), ("20", 3), ("x", 4), (None, 5))
    assert [r.id for r in df.transform(rl.sort("amount")).collect()] == [5, 3, 2, 1, 4]
    assert [r.id for r in df.transform(rl.sort("amount", "desc", limit=2)).collect()] == [4, 1]
    two = rows("dept string, salary int", ("B", 1), ("A", 20), ("A", 3))
    assert [tuple(r) for r in two.transform(rl.sort("dept, salary desc")).collect()] == [("A", 20), ("A", 3), ("B", 1)]
    assert [tuple(r) for r in two.transform(rl.sort(["dept", "salary"], "desc")).collect()][0] == ("B", 1)
    assert df.transform(rl.sort("amount")).columns == df.columns
    with pytest.raises(ValueError):
        rl.sort("")


@pytest.mark.parametrize("parts", [1, 8])
def test_sampling(rows, parts):
    df = rows("i int", *[(i,) for i in range(100)], parts=parts)
    assert rows.out(df.transform(rl.sampling("first", 3, order_by="i"))) == [(0,), (1,), (2,)]
    assert sorted(r.i for r in df.transform(rl.sampling("every", 30, order_by="i")).collect()) == [0, 30, 60, 90]
    assert df.transform(rl.sampling("every", 1, order_by="i")).count() == 100
    assert df.transform(rl.sampling("percent", 100)).count() == 100
    some = df.transform(rl.sampling("percent", 50, key="i", seed=3))
    assert 20 < some.count() < 80 and rows.out(some) == rows.out(df.transform(rl.sampling("percent", 50, key="i", seed=3)))
    with pytest.raises(ValueError):
        rl.sampling("first", 0)


def test_large_first(rows, monkeypatch):
    from rowloom.operators import rows as module
    monkeypatch.setattr(module, "LARGE_LIMIT", 5)
    df = rows("i int", *[(i,) for i in range(50)], parts=8)
    assert sorted(r.i for r in df.transform(rl.sampling("first", 20, order_by="i")).collect()) == list(range(20))


def test_union(rows):
    a, b = rows("id int, name string", (1, "a")), rows("id bigint, score double", (2, 1.5))
    out = rl.union(a, b)
    assert rows.out(out) == [(1, "a", None), (2, None, 1.5)]
    mixed = rl.union(rows("id int", (1,)), rows("id string", ("x",)))
    assert rows.out(mixed) == [("1",), ("x",)]
    with pytest.raises(ValueError):
        rl.union(a)

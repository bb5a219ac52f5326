import pytest

import rowloom as rl
from rowloom.plans.checks import plan_of


def test_join_inner_left(rows):
    left = rows("user_id string, name string", ("1", "a"), ("2", "b"), ("3", "c"))
    right = rows("id int, score int", (1, 10), (2, 20))
    out = rl.join(left, right, "user_id", "id")
    assert out.columns == ["user_id", "name", "score"]
    assert rows.out(out) == [("1", "a", 10), ("2", "b", 20)]
    assert rows.out(rl.join(left, right, "user_id", "id", "left")) == [("1", "a", 10), ("2", "b", 20), ("3", "c", None)]


def test_join_collision(rows):
    left = rows("id int, name string", (1, "a"))
    right = rows("id int, name string, score int", (1, "A", 5))
    out = rl.join(left, right, "id", "id")
    assert out.columns == ["id", "name", "right_name", "score"] and tuple(out.first()) == (1, "a", "A", 5)
    with pytest.raises(ValueError):
        rl.join(left, right.withColumnRenamed("score", "right_name"), "id", "id")


@pytest.mark.parametrize("split_hot", [False, True, "auto"])
@pytest.mark.parametrize("parts", [1, 8])
def test_join_outer(rows, split_hot, parts):
    left = rows("k int, a string", (1, "x"), (1, "y"), (2, "z"), (None, "n"), parts=parts)
    right = rows("k2 int, b string", (1, "p"), (1, "q"), (3, "r"), (None, "m"), parts=parts)
    go = lambda how, nulls=True: rows.out(rl.join(left, right, "k", "k2", how, nulls_match=nulls, split_hot=split_hot))
    both = [(1, "x", "p"), (1, "x", "q"), (1, "y", "p"), (1, "y", "q")]
    null = [(None, "n", "m")]
    assert go("inner") == null + both
    assert go("left") == null + both + [(2, "z", None)]
    assert go("right") == null + both + [(3, None, "r")]
    assert go("full") == null + both + [(2, "z", None), (3, None, "r")]
    assert go("full", False) == [(None, None, "m"), (None, "n", None)] + both + [(2, "z", None), (3, None, "r")]


def test_join_types_and_self(rows):
    df = rows("id int, up int", (1, None), (2, 1), (3, 1))
    assert rows.out(rl.join(df, df, "up", "id"), "id", "up", "right_up") == [(2, 1, None), (3, 1, None)]
    with pytest.raises(ValueError):
        rl.join(df, df, "id", "id", "cross")
    with pytest.raises(ValueError):
        rl.join(df, df, "", "id")
    text = rows("id string, v int", ("2", 1), ("x", 2))
    assert rows.out(rl.join(df, text, "id", "id", "full"), "id", "v") == [("1", None), ("2", 1), ("3", None), ("x", 2)]


@pytest.mark.parametrize("kinds", [("bigint", "double"), ("int", "bigint"), ("decimal(10,2)", "int"), ("string", "int")])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_one_key_type_for_every_form(spark, kinds, how):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int").selectExpr(f"cast(k as {kinds[0]}) k", "k * 10 a")
    right = spark.createDataFrame([("1.5",), ("2.0",), ("3000000000",)], "k string").selectExpr(f"try_cast(try_cast(k as double) as {kinds[1]}) k2", "k b")
    forms = [rl.join(left, right, "k", "k2", how, nulls_match=False, split_hot=s) for s in (False, True)]
    assert forms[0].schema == forms[1].schema
    wide = {"bigint": "double", "int": "bigint", "decimal(10,2)": "decimal(12,2)", "string": "string"}[kinds[0]]
    assert dict(forms[0].dtypes)["k"] == wide
    assert sorted(map(str, forms[0].collect())) == sorted(map(str, forms[1].collect()))
    keys = {r.k for r in forms[0].collect()}
    if kinds == ("bigint", "double"):
        assert keys == {"inner": {2.0}, "left": {1.0, 2.0, None}, "right": {1.5, 2.0, 3e9}, "full": {1.0, 2.0, None, 1.5, 3e9}}[how]
    if kinds == ("int", "bigint") and how in ("right", "full"):
        assert 3_000_000_000 in keys


def test_full_join_reads_each_input_once(rows):
    df = rows("id int, up int", (1, None))
    plan = plan_of(rl.join(df, df, "id", "id", "full"))
    assert "FullOuter" in plan and "LeftAnti" not in plan


@pytest.mark.parametrize("how, hot_side", [("left", "right"), ("right", "left"), ("full", "right")])
def test_hot_key_of_the_other_side_is_found(rows, monkeypatch, how, hot_side):
    from rowloom.operators import joins
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    hot, plain = rows("k int, a int", *[(1, i) for i in range(5)]), rows("k int, b int", (1, 1), (2, 2))
    left, right = (plain, hot) if hot_side == "right" else (hot, plain)
    split = plan_of(rl.join(left, right, "k", "k", how, split_hot="auto"))
    assert "Inner" in split and "LeftAnti" in split
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    assert "Inner" not in plan_of(rl.join(left, right, "k", "k", how, split_hot="auto"))
    with pytest.raises(ValueError):
        rl.join(left, right, "k", "k", how, split_hot="yes")


def test_merge(rows):
    left = rows("id int, name string", (1, "a"), (2, "b"), (3, "c"))
    right = rows("id int, dept string", (1, "x"), (4, "y"))
    assert rows.out(rl.merge(left, right, on="id")) == [(1, "a", "x")]
    assert rl.merge(left, right, "left", on="id").count() == 3
    assert rows.out(rl.merge(left, right, "outer", on="id")) == [(1, "a", "x"), (2, "b", None), (3, "c", None), (4, None, "y")]
    a, b = rows("id int, value int", (1, 5)), rows("id int, value int", (1, 6), (2, 7))
    out = rl.merge(a, b, "outer", on="id", left_suffix="_left", right_suffix="_right")
    assert rows.out(out, "id", "value_left", "value_right") == [(1, 5, 6), (2, None, 7)]
    assert rl.merge(a, b, left_on="id", right_on="value").columns == ["id", "value", "id_y"]
    with pytest.raises(ValueError):
        rl.merge(a, b)
    with pytest.raises(ValueError):
        rl.merge(a, b, "cross", on="id")


@pytest.mark.parametrize("validate, left_twice, right_twice, fails", [
    ("one_to_one", False, True, True), ("one_to_one", True, False, True), ("one_to_one", False, False, False),
    ("one_to_many", True, False, True), ("one_to_many", False, True, False), ("many_to_one", False, True, True),
    ("many_to_one", True, False, False), ("many_to_many", True, True, False),
])
def test_merge_validate(rows, validate, left_twice, right_twice, fails):
    left = rows("id int, a int", (1, 1), (1 if left_twice else 2, 2))
    right = rows("id int, b int", (1, 1), (1 if right_twice else 2, 2))
    if fails:
        with pytest.raises(ValueError, match="appears 2 times"):
            rl.merge(left, right, on="id", validate=validate)
    else:
        assert rl.merge(left, right, on="id", validate=validate).count() > 0
    with pytest.raises(ValueError):
        rl.merge(left, right, on="id", validate="1:1")


@pytest.mark.parametrize("parts", [1, 8])
def test_append_fields(rows, parts):
    left = rows("o int, v string", (3, "c"), (1, "a"), (2, "b"), parts=parts)
    right = rows("o int, w string", (20, "y"), (10, "x"), parts=parts)
    out = rl.append_fields(left, right, "o", "o")
    assert out.columns == ["o", "v", "right_o", "w"]
    assert rows.out(out) == [(1, "a", 10, "x"), (2, "b", 20, "y"), (3, "c", None, None)]


def test_join_int_keys_with_customers_past_the_int_range(spark, rows, tmp_path):
    from rowloom.plans.queries import join_int_keys
    customers = rows("c_custkey bigint, c_name string", (1, "a"), (2, "b"), (2147, "c"), (2148, "d"), (2148, "e"), (9000, None), (9001, "g"), (None, "n"))
    orders = rows("o_orderkey bigint, o_orderstatus string", (2, "F"), (2148, "O"), (2148, "P"), (9000, "F"), (70000, "O"), (7, None), (None, "N"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    out = join_int_keys(spark, str(tmp_path))
    assert out.dtypes == [("c", "bigint"), ("c_name", "string"), ("o_orderstatus", "string")]
    m = 1_000_000
    assert rows.out(out) == sorted([
        (None, "n", "N"), (m, "a", None), (2 * m, "b", "F"), (2147 * m, "c", None), (2148 * m, "d", "O"), (2148 * m, "d", "P"),
        (2148 * m, "e", "O"), (2148 * m, "e", "P"), (9000 * m, None, "F"), (9001 * m, "g", None), (70000 * m, None, "O"), (7 * m, None, None),
    ], key=lambda r: tuple((v is not None, str(v)) for v in r))

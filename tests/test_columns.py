import pytest

import rowloom as rl
from rowloom.functions.parsing import number_text, parse_bool, parse_double, parse_long
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_parsing_grammar(rows):
    texts = ["2", " 2 ", "1d", "1e3", ".5", "5.", "inf", "-Infinity", "nan", "abc", "", None, "0x10", "3.0", "yes", "T", "0", "2\n"]
    df = rows("i int, s string", *enumerate(texts))
    s, kind = F.col("s"), T.StringType()
    got = {r.i: r for r in df.select("i", parse_double(s, kind).alias("d"), parse_long(s, kind).alias("l"),
                                     parse_bool(s, kind).alias("b")).collect()}
    assert [got[i].d for i in (0, 1, 2, 3, 4, 5)] == [2.0, None, None, 1000.0, 0.5, 5.0]
    assert got[6].d == float("inf") and got[7].d == float("-inf") and got[8].d != got[8].d
    assert [got[i].d for i in (9, 10, 11, 12, 13, 17)] == [None, None, None, None, 3.0, None]
    assert [got[i].l for i in (0, 1, 13, 16, 9)] == [2, None, None, 0, None]
    assert [got[i].b for i in (14, 15, 16, 0)] == [None, True, False, None]


def test_number_text(rows):
    values = [100.0, 1.5, 0.0, -0.25, 12345678.9, 1e21, 1.5e-7, 1e20, 123456789012.0, 0.000123, None, float("nan"), float("inf")]
    df = rows("i int, x double", *enumerate(values))
    got = {r.i: r.t for r in df.select("i", number_text(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [
        "100", "1.5", "0", "-0.25", "12345678.9", "1e+21", "1.5e-07", "100000000000000000000", "123456789012", "0.000123",
        None, "NaN", "+Inf"]


def test_select(rows):
    df = rows("id int, name string, age int", (1, "a", 5), (2, "b", 6))
    assert df.transform(rl.select("id, name")).columns == ["id", "name"]
    out = df.transform(rl.select(["id", "inexistant"]))
    assert rows.out(out) == [(1, None), (2, None)]
    with pytest.raises(ValueError):
        rl.select("")


def test_rename(rows):
    df = rows("user_id int, first_name string, score int", (1, "a", 5))
    assert df.transform(rl.rename("user_id:id,first_name:prenom")).columns == ["id", "prenom", "score"]
    assert df.transform(rl.rename("inexistant:nouveau")).columns == df.columns
    with pytest.raises(ValueError):
        df.transform(rl.rename("inexistant:nouveau", errors="raise"))
    with pytest.raises(ValueError):
        rl.rename("a-b")
    with pytest.raises(ValueError):
        df.transform(rl.rename("user_id:score"))
    assert df.transform(rl.map_columns({"score": "points", "x": "y"})).columns == ["user_id", "first_name", "points"]


def test_cast(rows):
    df = rows("score string, price string, active string, count int", ("42", "3.14", "true", 99), (None, None, "false", None))
    assert rows.out(df.transform(rl.cast("score", "int")), "score") == [(None,), (42,)]
    assert rows.out(df.transform(rl.cast("price", "float")), "price") == [(None,), (3.14,)]
    assert rows.out(df.transform(rl.cast("active", "bool")), "active") == [(False,), (True,)]
    assert rows.out(df.transform(rl.cast("count", "string")), "count") == [(None,), ("99",)]
    with pytest.raises(ValueError):
        rl.cast("x", "datetime")
    bad = rows("x string", ("3.0",), ("7",))
    with pytest.raises(Exception, match="cast"):
        bad.transform(rl.cast("x", "int")).collect()
    assert rows.out(bad.transform(rl.cast("x", "int", errors="null"))) == [(None,), (7,)]
    assert df.transform(rl.casts({"score": "int", "absent": "int"})).dtypes[0] == ("score", "bigint")


@pytest.mark.parametrize("expression, expected", [
    ("amount * 1.2", 120.0), ("amount + tax", 120.0), ("amount - tax", 80.0), ("amount / tax", 5.0), ("'EU'", "EU"),
    ("42", 42.0), ("country", "FR"), ("-5", -5.0), ("1e-5", 1e-5), ("amount / 0", None), ("b-c + 1", 3.0),
])
def test_add_column(rows, expression, expected):
    df = rows("amount double, tax string, country string, `b-c` int", (100.0, "20", "FR", 2))
    out = df.transform(rl.add_column("v", expression, errors="null")).first()
    assert out.v == expected and out.amount == 100.0


def test_add_column_errors(rows):
    df = rows("amount string, n int", ("x", 0))
    with pytest.raises(ValueError):
        df.transform(rl.add_column("v", "foo bar"))
    with pytest.raises(Exception, match="number"):
        df.transform(rl.add_column("v", "amount + 1")).collect()
    with pytest.raises(Exception, match="zero"):
        df.transform(rl.add_column("v", "1 / n")).collect()
    assert df.transform(rl.add_column("n", "n + 1")).first().n == 1.0
    assert df.transform(rl.add_column("v", "upper(amount)", sql=True)).first().v == "X"


def test_auto_field(rows):
    df = rows("i string, f string, b string, t string, e string, n int",
              ("1", "1.5", "true", "x", None, 1), ("2", "3", "f", "2", "", 2), (None, "", None, None, None, None))
    out = df.transform(rl.auto_field())
    assert dict(out.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "e": "string", "n": "int"}
    assert rows.out(out, "f") == [(None,), (1.5,), (3.0,)]


def test_fillna(rows):
    df = rows("name string, score string, x double", ("Alice", "", 1.0), ("", "95", float("nan")), ("NULL", "80", None))
    out = df.transform(rl.fillna(0))
    assert rows.out(out) == [("0", "80", 0.0), ("0", "95", 0.0), ("Alice", "0", 1.0)]
    only = rows("a string, b string, c string", ("", "", "ok")).transform(rl.fillna("X", "a"))
    assert rows.out(only) == [("X", "", "ok")]
    with pytest.raises(ValueError):
        rl.fillna("")

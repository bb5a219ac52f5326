"""Inputs that are wrong or unusual fail or are read whole; nothing goes without a word."""

import pytest
from pyspark.sql import functions as F

import rowloom as rl


def raises(df):
    with pytest.raises(Exception):
        df.collect()


@pytest.mark.parametrize("body", ['[{"a":1},{"a":2}', '{"a":4', "nonsense", '"text"'])
def test_json_that_is_cut_off(rows, body):
    df = rows("body string", (body,), ('[{"a":7}]',), (None,))
    raises(rl.explode_records(df, "body", "a int"))
    assert rows.out(rl.explode_records(df, "body", "a int", errors="null")) == [(7,)]


def test_json_pages_beyond_the_hundredth(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"page{i}.json").write_text('[{"a":%d}%s]' % (i, "" if i == 120 else ',{"a":-1}'))
    assert rl.json_pages(spark, str(tmp_path), "a int").count() == 299
    assert rl.json_pages(spark, str(tmp_path), "a int", page_size=2).count() == 241  # ends with the short page
    assert rl.json_pages(spark, str(tmp_path), "a int", page_size=2, max_pages=10).count() == 20
    (tmp_path / "other.json").write_text('[{"a":1}]')
    raises(rl.json_pages(spark, str(tmp_path), "a int", page_size=2, page_pattern=r"page(\d+)"))
    assert rl.json_pages(spark, str(tmp_path), "a int").count() == 300


def test_preview_honours_its_limit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(map(str, range(900))))
    assert rl.csv_preview(spark, str(tmp_path), limit=500).count() == 500
    with pytest.raises(ValueError):
        rl.csv_preview(spark, str(tmp_path), limit=0)


def test_files_with_other_headers(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("﻿name,id\r\nz,3\r\n")
    (tmp_path / "c.csv").write_text("id,name\n4,w\n")
    assert rows.out(rl.read_csv(spark, str(tmp_path)), "id", "name") == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "w")]
    (tmp_path / "d.csv").write_text("id,town\n5,v\n")
    with pytest.raises(ValueError, match="other columns"):
        rl.read_csv(spark, str(tmp_path))


def test_small_shares_are_drawn(spark):
    ids = spark.range(10_000_000)
    assert 200 < 100 * ids.transform(rl.sampling("percent", 0.00005, key="id")).count() < 1500
    assert spark.range(50).transform(rl.sampling("percent", 100, key="id")).count() == 50


@pytest.mark.parametrize("op", [None, "TRUNCATE", "upd"])
def test_unknown_operations_fail(rows, op):
    snapshot = rows("id int, v int", (1, 10), (2, 20))
    changes = rows("id int, v int, _op string, s int", (1, 11, op, 1))
    raises(rl.apply_changes(snapshot, changes, "id", "s"))
    good = changes.withColumn("_op", F.lit("update"))
    assert rows.out(rl.apply_changes(snapshot, good, "id", "s")) == [(1, 11), (2, 20)]


def test_operators_and_commas_inside_quotes(rows):
    df = rows("n string, k int", ("a==c", 1), ("b", 2), ("x,y", 3), ("it's", 4))
    assert rows.out(df.transform(rl.filter_rows("n != 'a==c'")), "k") == [(2,), (3,), (4,)]
    assert rows.out(df.transform(rl.filter_rows("n == 'x,y'")), "k") == [(3,)]
    parts = rl.split(df, "n == 'x,y', k >= 2, n == \"it's\"")
    assert [rows.out(p, "k") for p in parts] == [[(3,)], [(2,), (4,)], [], [(1,)]]
    with pytest.raises(ValueError):
        df.transform(rl.filter_rows("missing == 1"))


def test_literal_runs_of_patterns(rows):
    df = rows("t string", ("a $5 b",), ("x[1]^y",))
    assert rows.out(df.transform(rl.regex("t", r"(\Q$5\E)", "match"))) == [("a $5 b",)]
    from rowloom.functions.patterns import translate
    hit = lambda p, t: df.limit(1).select(F.lit(t).rlike(translate(p).java)).first()[0]
    assert hit(r"(\Q$5\E)", "a $5 b") and hit(r"\Q[1]^", "x[1]^y") and hit(r"\Qé.\E$", "é.") and not hit(r"\Q.\E", "x")


def test_one_pass_for_many_tests(rows):
    from rowloom.plans.checks import plan_of
    df = rows("v int, t string", (1, "ab"), (5, None))
    out = df.transform(rl.match_advanced([("v", "gt", 2, "number"), ("t", "contains", "a", "string")]))
    assert rows.out(out, "v", "_match") == [(1, [False, True]), (5, [True, False])]
    assert "Union" not in plan_of(out)

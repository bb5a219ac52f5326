import datetime as dt

import pytest

import rowloom as rl
from rowloom.functions.dates import layout_to_pattern
from rowloom.functions.patterns import template, translate
from pyspark.sql import functions as F


def test_data_cleansing(rows):
    df = rows("a string, n int", ("   Héllo, W0rld!\t", 1), ("", 2), ("　", 3), (None, 4))
    out = df.transform(rl.data_cleansing(trim=True, to_lower=True, remove_special=True, nullify_empty=True))
    assert rows.out(out) == [(None, 2), (None, 3), (None, 4), ("héllo w0rld", 1)]
    assert out.dtypes[1] == ("n", "int")
    assert df.transform(rl.data_cleansing("n", to_upper=True)).dtypes[1] == ("n", "string")


@pytest.mark.parametrize("mode, find, replace, expected", [
    ("contains", "a.", "X", "bXna"), ("exact", "ba.na", "X", "X"), ("exact", "a", "X", "ba.na"),
    ("regex", "a(.)", "<$1>", "b<.>na"), ("regex", "(?P<v>[an])", "${v}${v}", "baa.nnaa"),
])
def test_find_replace(rows, mode, find, replace, expected):
    df = rows("s string", ("ba.na",)) if mode != "regex" or find != "a(.)" else rows("s string", ("ba.na"[:5],))
    got = df.transform(rl.find_replace("s", find, replace, mode)).first().s
    assert got == ("b<.>na" if find == "a(.)" else expected)
    with pytest.raises(ValueError):
        rl.find_replace("s", find, replace, "fuzzy")


def test_regex(rows):
    df = rows("s string", ("order-12",), ("none",), (None,))
    assert rows.out(df.transform(rl.regex("s", r"(\d+)"))) == [(None, ""), ("none", ""), ("order-12", "12")]
    assert rows.out(df.transform(rl.regex("s", r"\d+", output="o")), "o") == [("",), ("",), ("",)]
    assert rows.out(df.transform(rl.regex("s", r"\d", "replace", "#"))) == [(None,), ("none",), ("order-##",)]
    assert rows.out(df.transform(rl.regex("s", r"^n", "match"))) == [("none",)]
    with pytest.raises(ValueError):
        rl.regex("s", "a", "split")


@pytest.mark.parametrize("pattern, text, group", [
    (r"(?P<first_name>\w+)$", "a\nbob", "bob"), (r"([[:alpha:]]+)", "12ab", "ab"), (r"([^[:digit:]]+)", "12ab", "ab"),
    (r"(\s+)", "a\x0b b", " "), (r"([\s\d]+)", "a 1b", " 1"), (r"(a[&[]b)", "a[b", "a[b"), (r"(\p{Greek}+)", "xαβ", "αβ"),
    (r"(a.b)", "a\rb", "a\rb"), (r"(b$)", "b\n", ""), (r"(?:x)(y)", "xy", "y"), (r"([]a]+)", "]a", "]a"), (r"(\S+)", " ab ", "ab"),
])
def test_translated_patterns(rows, pattern, text, group):
    got = rows("s string", (text,)).transform(rl.regex("s", pattern, output="o")).first().o
    assert got == group


def test_pattern_template():
    p = translate(r"(a)(?P<x_y>b)")
    assert p.groups == 2
    assert template("$1-${1}0$$", p) == r"$1-$1\0\$"
    assert template("${x_y}$1x$9", p) == "${xU5Fy}"
    with pytest.raises(ValueError):
        translate("(?U)a+")


def test_text_to_columns(rows):
    df = rows("s string", ("a, b ,c",), ("d",), (None,))
    out = df.transform(rl.text_to_columns("s"))
    assert out.columns == ["s", "s_1", "s_2", "s_3"]
    assert rows.out(out, "s_1", "s_2", "s_3") == [(None, None, None), ("a", "b", "c"), ("d", None, None)]
    two = df.transform(rl.text_to_columns("s", ",", "p", max_split=2))
    assert rows.out(two, "p1", "p2") == [(None, None), ("a", "b ,c"), ("d", None)]
    piped = rows("s string", ("x||y|z",)).transform(rl.text_to_columns("s", "||"))
    assert tuple(piped.first())[1:] == ("x", "y|z")


@pytest.mark.parametrize("layout, pattern", [
    ("2006-01-02", "yyyy-MM-dd"), ("2006-01-02T15:04:05", "yyyy-MM-dd'T'HH:mm:ss"), ("02/01/06", "dd/MM/yy"),
    ("Jan 2, 2006", "MMM d, yyyy"), ("Monday 15h04", "EEEE HH'h'mm"), ("03:04 PM", "hh:mm a"),
    ("2006-01-02 15:04:05.000", "yyyy-MM-dd HH:mm:ss.SSS"), ("yyyy-MM-dd", "yyyy-MM-dd"), ("20060102", "yyyyMMdd"),
])
def test_layouts(layout, pattern):
    assert layout_to_pattern(layout) == pattern


def test_datetime(rows):
    df = rows("d string", ("2024-02-28",), ("bad",), (None,), ("2024-02-28x",))
    assert rows.out(df.transform(rl.datetime("d", output_format="02/01/2006"))) == [
        (None,), ("2024-02-28x",), ("28/02/2024",), ("bad",)]
    added = df.transform(rl.datetime("d", "add", add_value=2, output_format="2006-01-02", output="o"))
    assert rows.out(added, "o") == [(None,), (None,), (None,), ("2024-03-01",)]
    hours = df.transform(rl.datetime("d", "add", add_unit="hours", add_value=25.9, output="o"))
    assert ("2024-02-29T01:00:00",) in rows.out(hours, "o")
    minutes = df.transform(rl.datetime("d", "add", add_unit="minutes", add_value=-1, output="o"))
    assert ("2024-02-27T23:59:00",) in rows.out(minutes, "o")
    for part, value in (("year", 2024), ("month", 2), ("day", 28), ("weekday", "Wednesday"), ("hour", 0)):
        assert df.filter("d = '2024-02-28'").transform(rl.datetime("d", "extract", extract=part, output="o")).first().o == value
    fraction = rows("d string", ("2024-01-01 10:00:01.25",))
    got = fraction.transform(rl.datetime("d", input_format="2006-01-02 15:04:05", output_format="15:04:05.000")).first().d
    assert got == "10:00:01.250"


def test_datetime_typed_and_diff(rows):
    df = rows("a timestamp, b timestamp_ntz, c date", (dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 3), dt.date(2024, 1, 31)))
    assert df.transform(rl.datetime("b", "add", add_unit="hours", add_value=1)).dtypes[1][1] == "timestamp_ntz"
    assert df.transform(rl.datetime("b", "extract", extract="day")).first().b == 3
    assert df.transform(rl.datetime("c", "format", output_format="2006/01")).first().c == "2024/01"
    assert df.transform(rl.datetime("a", "diff", other="b", unit="hours", output="h")).first().h == -43
    with pytest.raises(ValueError):
        rl.datetime("a", "diff")
    with pytest.raises(ValueError):
        rl.datetime("a", "add", add_unit="weeks")

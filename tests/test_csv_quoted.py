"""Delimited files with line breaks in quotes, cut into blocks of a few bytes, against Spark's reader of whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

import rowloom as rl
from rowloom.sources import csv as csv_source
from rowloom.sources import quoted


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 150 bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("150", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def cell(rng, d, sep):
    kind = rng.random()
    text = "".join(rng.choice(["a", "bc", "é", " ", d, '""', sep, sep + sep, "x" * 30]) for _ in range(rng.randint(0, 5)))
    if kind < 0.5:
        return f'"{text}"'
    plain = re.sub(f'["{re.escape(d)}\r\n]', "", text)
    if kind < 0.6:
        return plain + 'q"uote'  # literal
    if kind < 0.65:
        return f'"{plain}"tail'  # up to the delimiter
    return plain


def content(rng, d, sep, rows, width=3):
    lines = [d.join(f"c{i}" for i in range(width))]
    lines += [d.join(cell(rng, d, sep) for _ in range(rng.choice([width, width, width, 1]))) for _ in range(rows)]
    return sep.join(lines) + rng.choice(["", sep])


def same(spark, path, **options):
    split = rl.read_csv(spark, path, **options)
    whole = rl.read_csv(spark, path, multi_line=True, **options)
    assert split.columns == whole.columns
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert key(split) == key(whole)
    return split


@pytest.mark.parametrize("seed,d,sep,trim,encoding", [(1, ",", "\n", True, "utf-8"), (2, ";", "\r\n", False, "utf-8"), (3, "\t", "\n", True, "cp1252"),
                                                       (4, "|", "\n", False, "latin1"), (5, ",", "\r\n", True, "utf-8")])
def test_blocks_give_the_records_of_whole_files(spark, small_blocks, tmp_path, seed, d, sep, trim, encoding):
    rng = random.Random(seed)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(content(rng, d, sep, 25).encode(encoding))
    df = same(spark, str(tmp_path), delimiter=d, encoding=encoding, trim_leading_space=trim)
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    assert quoted.lines_of(spark, str(tmp_path), "\n").select("file", "start").distinct().count() > 12
    if seed < 3:
        same(spark, str(tmp_path), delimiter=d, encoding=encoding, trim_leading_space=trim, has_header=False, blank_as="null")


def test_one_record_over_many_blocks(spark, small_blocks, tmp_path):
    """A field of two hundred lines, blank lines among them, between ordinary records."""
    field = "\n".join("" if i % 7 == 0 else f"line {i}, with a comma" for i in range(200))
    (tmp_path / "a.csv").write_text(f'k,v\n1,plain\n2,"{field}"\n3,"{field}"\n4,end\n')
    out = {r["k"]: r["v"] for r in rl.read_csv(spark, str(tmp_path)).collect()}
    assert out == {"1": "plain", "2": field, "3": field, "4": "end"}


def test_a_quote_that_never_closes_takes_the_rest_of_its_file_only(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"open\n2,b\n3,c')
    (tmp_path / "b.csv").write_text("k,v\n4,d\n5,e\n")
    assert sorted(tuple(r) for r in rl.read_csv(spark, str(tmp_path)).collect()) == [("1", "open\n2,b\n3,c"), ("4", "d"), ("5", "e")]


def test_stray_quotes_do_not_need_assembly(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,5" pipe\n2,6" pipe\n3,"x"y"\n')
    df = rl.read_csv(spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in df.collect())[:2] == [("1", '5" pipe'), ("2", '6" pipe')]


def test_other_ways_beyond_the_bounds(spark, small_blocks, tmp_path, monkeypatch):
    """Lone carriage returns, and too many blocks that start inside a field: the files are read whole."""
    (tmp_path / "a.csv").write_bytes(b'k,v\n1,"a\rb"\n2,"c\nd"\n')
    assert sorted(tuple(r) for r in rl.read_csv(spark, str(tmp_path)).collect()) == [("1", "a\rb"), ("2", "c\nd")]
    (tmp_path / "a.csv").write_text("k,v\n" + '1,"a\n\n\nb"\n' * 50)
    want = sorted(tuple(r) for r in rl.read_csv(spark, str(tmp_path)).collect())
    monkeypatch.setattr(quoted, "MOST_BLOCKS", 1)
    df = rl.read_csv(spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and sorted(tuple(r) for r in df.collect()) == want
    assert want == [("1", "a\n\n\nb")] * 50


def test_many_orders_of_names(spark, small_blocks, tmp_path, monkeypatch):
    """Files of several orders of names, with open fields and without, in one read."""
    (tmp_path / "a.csv").write_text('k,v,w\n1,"x\ny",p\n')
    (tmp_path / "b.csv").write_text("w,k,v\nq,2,z\n")
    (tmp_path / "c d.csv").write_text("﻿v,w,k\n\nu,r,3\n")
    want = [("1", "x\ny", "p"), ("2", "z", "q"), ("3", "u", "r")]
    assert sorted(tuple(r) for r in rl.read_csv(spark, str(tmp_path)).select("k", "v", "w").collect()) == want
    (tmp_path / "a.csv").write_text("k,v,w\n1,x,p\n")
    df = rl.read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("k", "v", "w").collect()) == [("1", "x", "p"), *want[1:]]
    monkeypatch.setattr(csv_source, "MOST_HEADERS", 2)
    with pytest.raises(ValueError, match="different first lines"):
        rl.read_csv(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("w,k,other\nq,2,z\n")
    monkeypatch.setattr(csv_source, "MOST_HEADERS", 100)
    with pytest.raises(ValueError, match="other columns"):
        rl.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("line,outside,inside", [('a,b', False, True), ('a,"b', True, False), ('a,"b""', True, False), ('"a""b"', False, False),
                                                  ('a"b', False, False), (' "a', True, False), ('"a"b"c,d', False, False), ('"', True, False), ('""', False, True),
                                                  ('x","y', True, True), ('x""', False, True), ('', False, True)])
def test_line_rules(spark, line, outside, inside):
    rules = [re.compile(p) for p in quoted.closed_lines(",", True)]
    assert [r.fullmatch(line) is None for r in rules] == [outside, inside]
    assert spark.range(1).select(quoted.is_open(F.lit(line), ",", True).alias("x")).first()["x"] == outside


def test_strict_width(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rl.read_csv(spark, str(tmp_path), fields_per_record=2).collect()

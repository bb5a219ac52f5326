import json

import pytest

import rowloom as rl
from rowloom.plans.checks import plan_of
from rowloom.sinks.jdbc import table_writer
from rowloom.sources.jdbc import connection, query_options


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_read_csv(spark, rows, tmp_path):
    path = put(tmp_path / "a.csv", 'name, age ,\nAlice,30,"x ""y"""\nBob\nCarl,1,2,3\n\n,,\n')
    df = rl.read_csv(spark, path)
    assert df.columns == ["name", "age", "column_3"]
    assert rows.out(df) == [("", "", ""), ("Alice", "30", 'x "y"'), ("Bob", "", ""), ("Carl", "1", "2")]
    assert rl.read_csv(spark, path, skip_empty_lines=True).count() == 3
    assert ("Bob", None, None) in rows.out(rl.read_csv(spark, path, blank_as="null"))
    with pytest.raises(Exception):
        rl.read_csv(spark, path, fields_per_record=3).collect()
    with pytest.raises(ValueError):
        rl.read_csv(spark, path, fields_per_record=2)
    assert rl.csv_preview(spark, path, 2).count() == 2


def test_read_csv_without_header(spark, rows, tmp_path):
    path = put(tmp_path / "a.csv", "1;2\n3;4\n")
    assert rows.out(rl.read_csv(spark, path, ";", has_header=False)) == [("1", "2"), ("3", "4")]
    assert rl.read_csv(spark, path, ";", has_header=False).columns == ["column_1", "column_2"]
    assert rl.read_csv(spark, path, ";", has_header=False, auto_names="letters").columns == ["A", "B"]
    assert rl.read_csv(spark, path, ";", has_header=False, headers="x,y").columns == ["x", "y"]


@pytest.mark.parametrize("encoding, python", [
    ("utf-8", "utf-8"), ("windows-1252", "cp1252"), ("iso-8859-1", "latin-1"), ("utf-16le", "utf-16-le"), ("utf-16be", "utf-16-be")])
@pytest.mark.parametrize("multi_line", [None, False])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_read_csv_encodings(spark, rows, tmp_path, encoding, python, eol, multi_line):
    text = eol.join(["prénom\tville", "Zoé\tOrléans", "Léa\tSète", ""])
    path = put(tmp_path / "a.csv", (("﻿" + text) if "16" in encoding else text).encode(python))
    df = rl.read_csv(spark, path, "tab", encoding=encoding, multi_line=multi_line)
    assert df.columns == ["prénom", "ville"] and rows.out(df) == [("Léa", "Sète"), ("Zoé", "Orléans")]


def test_read_csv_cr_and_several_files(spark, rows, tmp_path):
    put(tmp_path / "d" / "1.csv", "a,b\r1,2\r")
    put(tmp_path / "d" / "2.csv", "a,b\r3,4\r")
    assert rows.out(rl.read_csv(spark, str(tmp_path / "d"), newline="cr")) == [("1", "2"), ("3", "4")]
    multi = put(tmp_path / "m.csv", 'a,b\n"x\ny",2\n')
    assert rows.out(rl.read_csv(spark, multi)) == [("x\ny", "2")]
    assert rl.read_csv(spark, multi, multi_line=False).count() == 2
    assert rows.out(rl.csv_preview(spark, multi)) == [("x\ny", "2")]
    with pytest.raises(ValueError):
        rl.read_csv(spark, multi, encoding="ebcdic")


def test_csv_scan(spark, tmp_path):
    put(tmp_path / "a.csv", "name,age,city\nAlice,30,Paris\nBob,25,Lyon\n")
    put(tmp_path / "b.csv", "prénom;2;3\r\nx;5;6\r\n".encode("cp1252"))
    put(tmp_path / "c.csv", "1|2|3\r4|5|6\r")
    put(tmp_path / "d.csv", "﻿id\tnom\tv\n1\té\t2\n".encode("utf-16"))
    put(tmp_path / "e.csv", "just text\nmore\n")
    put(tmp_path / "f.csv", "\n \n")
    put(tmp_path / "skip.txt", "x")
    got = {r.path[-5]: r for r in rl.csv_scan(spark, str(tmp_path), "*.csv").collect()}
    view = lambda k: (got[k].encoding, got[k].delimiter, got[k].newline, got[k].has_header, got[k].confidence)
    assert view("a") == ("utf-8", ",", "auto", True, "high") and got["a"].headers == ["name", "age", "city"]
    assert view("b") == ("windows-1252", ";", "auto", False, "high")
    assert view("c") == ("utf-8", "|", "cr", False, "high") and got["c"].headers == ["column_1", "column_2", "column_3"]
    assert view("d")[:3] == ("utf-16le", "\t", "auto") and got["d"].detected_columns == 3
    assert view("e")[4] == "low" and len(got["e"].warnings) >= 1
    assert got["f"].detected_columns == 0 and len(got) == 6


def test_write_csv(spark, rows, tmp_path):
    df = rows("name string, age int, x double", ("Bob, Jr", 25, 100.0), (None, 30, 1.5))
    out = str(tmp_path / "out")
    rl.write_csv(df, out, single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert sorted(text.splitlines()) == sorted(["age,name,x", '25,"Bob, Jr",100', "30,,1.5"])
    rl.write_csv(df, out, append=True)
    assert rl.read_csv(spark, out, has_header=False, headers="age,name,x").count() >= 4
    rl.write_csv(df, str(tmp_path / "o2"), columns="name,age", single_file=True, delimiter=";")
    assert [p.read_text().splitlines()[0] for p in (tmp_path / "o2").glob("part*")] == ["name;age"]


def test_end_to_end(spark, rows, tmp_path):
    path = put(tmp_path / "in.csv", "prenom,age,statut\nAlice,30,active\nBob,17,inactive\nCarla,25,active\n")
    df = rl.read_csv(spark, path).transform(rl.chain(
        rl.map_columns({"prenom": "name"}), rl.filter_rules([("statut", "eq", "active")]), rl.casts({"age": "int"})))
    rl.write_csv(df, str(tmp_path / "out"), column_order="as_is", single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert text.splitlines() == ["name,age,statut", "Alice,30,active", "Carla,25,active"]


def test_inline(spark, rows):
    assert rows.out(rl.text_input(spark, "a,b\\n1, 2\\n3")) == [("1", "2"), ("3", "")]
    df = rl.data_grid(spark, '["id","name","ok","mix"]', '[[1,"a",true,1],[2.5,null,false,"x"]]')
    assert [t for _, t in df.dtypes] == ["double", "string", "boolean", "string"]
    assert rl.data_grid(spark, ["a", "b"], "[]").count() == 0
    for columns, body in ((["a", "b", "c"], '[["1","2"]]'), (["a"], "not json"), ([], "[]"), (["a"], '{"a":1}')):
        with pytest.raises(ValueError):
            rl.data_grid(spark, columns, body)
    with pytest.raises(ValueError, match="row 0"):
        rl.data_grid(spark, ["a", "b", "c"], '[["1","2"]]')
    now = rl.clock(spark).first()
    assert now.year >= 2024 and now.datetime.startswith(now.date) and now.weekday.endswith("day")


def test_directory(spark, tmp_path):
    put(tmp_path / "a.csv", "12345")
    put(tmp_path / "b.tar.gz", "1")
    put(tmp_path / "plain", "")
    df = rl.directory(spark, str(tmp_path))
    got = {r.name: (r.extension, r.size) for r in df.collect()}
    assert got == {"a.csv": (".csv", 5), "b.tar.gz": (".gz", 1), "plain": ("", 0)}
    assert [r.name for r in rl.directory(spark, str(tmp_path), "*.csv").collect()] == ["a.csv"]
    assert "content" not in plan_of(df)


def test_json_pages(spark, rows, tmp_path):
    for n, body in enumerate(([{"id": 1}, {"id": 2}], [{"id": 3}, 7, {"id": 4}], [{"id": 5}], [{"id": 6}, {"id": 7}])):
        put(tmp_path / "p" / f"page-{n}.json", json.dumps({"items": body, "n": n}))
    folder = str(tmp_path / "p")
    assert [r[0] for r in rows.out(rl.json_pages(spark, folder, "id bigint", "items"))] == [1, 2, 3, 4, 5, 6, 7]
    assert [r[0] for r in rows.out(rl.json_pages(spark, folder, "id bigint", "items", page_size=2))] == [1, 2, 3, 4, 5]
    assert [r[0] for r in rows.out(rl.json_pages(spark, folder, "id bigint", "items", page_size=2, max_pages=1))] == [1, 2]
    one = put(tmp_path / "o" / "x.json", '{"a": 1, "b": "t"}')
    assert rows.out(rl.json_pages(spark, one)) == [(1, "t")]
    nested = put(tmp_path / "n" / "x.json", '{"data": {"a": 1, "b": [1,2]}}')
    assert rows.out(rl.json_pages(spark, nested, data_path="data"), "a") == [(1,)]
    wrong = put(tmp_path / "w" / "x.json", '"text"')
    with pytest.raises(Exception, match="json body"):
        rl.json_pages(spark, wrong, "a int").collect()


@pytest.mark.parametrize("dsn, url, driver", [
    ("postgres://me:p%40ss@db:6543/shop?sslmode=disable", "jdbc:postgresql://db:6543/shop?sslmode=disable", "org.postgresql.Driver"),
    ("mysql://me:p%40ss@db/shop", "jdbc:mysql://db:3306/shop", "com.mysql.cj.jdbc.Driver"),
    ("sqlserver://me:p%40ss@db?database=shop", "jdbc:sqlserver://db:1433;databaseName=shop",
     "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
])
def test_connection(dsn, url, driver):
    assert connection(dsn) == {"url": url, "driver": driver, "user": "me", "password": "p@ss"}


def test_connection_of_a_jdbc_url():
    assert connection("jdbc:postgresql://db/x")["driver"] == "org.postgresql.Driver"
    assert connection("jdbc:other:x") == {"url": "jdbc:other:x"}
    for bad in ("", "db/x", "oracle://db/x"):
        with pytest.raises(ValueError):
            connection(bad)


def test_jdbc_options(rows):
    """Options only: no database runs in the tests."""
    assert query_options("jdbc:x", "select 1;")["query"] == "select 1"
    ranged = query_options("jdbc:x", "select * from t", "id", 0, 100, 8, user="u")
    assert ranged["dbtable"] == "(select * from t) t" and ranged["numPartitions"] == "8" and ranged["user"] == "u"
    for bad in (dict(url="", query="q"), dict(url="jdbc:x", query=" "), dict(url="jdbc:x", query="q", partition_column="id")):
        with pytest.raises(ValueError):
            query_options(**bad)
    df = rows("a int", (1,))
    assert table_writer(df, "jdbc:x", "t", mode="truncate") is not None
    for bad in (dict(url="", table="t"), dict(url="jdbc:x", table="t", mode="merge")):
        with pytest.raises(ValueError):
            table_writer(df, **bad)
    with pytest.raises(ValueError):
        rl.write_table(df, "jdbc:x", "t", mode="upsert")


def test_previews(rows):
    df = rows("a int, b string", *[(i, None) for i in range(30)])
    assert rl.preview(df, 5).count() == 5
    assert rl.browse(df, 2).first().json in ('{"a":%d,"b":null}' % i for i in range(30))
    out, seen = rl.counted(df, "step")
    out.filter("a < 3").collect()
    assert seen.get["rows"] == 30


def test_csv_scan_reads_no_large_file_whole(spark, tmp_path):
    from rowloom.sources.dialect import scan_bytes
    line = "12;é;34.5;x y"
    contents = {
        "lf": "\n".join(["id;nom;v;t", *[line] * 100_000]).encode(),
        "crlf": "\r\n".join(["id;nom;v;t", *[line] * 100_000, ""]).encode("utf-8-sig"),
        "cr": "\r".join(["\n\nid;nom;v;t", *[line] * 100_000]).encode(),
        "late": "\n".join(["id;nom;v;t", *[line] * 100_000, ""]).encode() + b"1;\xe9;2;3\r",
        "late mark +%41": "\n".join(["id;nom;v;t", *[line] * 100_000]).encode("utf-8-sig") + b";\xe9\r\n",
        "utf16": "\r\n".join(["id;nom;v;t", *[line] * 100_000]).encode("utf-16"),
        "small": b"a,b\n1,2\n",
    }
    for name, raw in contents.items():
        put(tmp_path / f"{name}.csv", raw)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_000_000)
    try:
        got = {r.path.split("/")[-1][:-4]: tuple(r) for r in rl.csv_scan(spark, str(tmp_path), "*.csv").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: scan_bytes(f"file:{tmp_path}/{name}.csv", raw) for name, raw in contents.items()}
    assert {n: (g[1], g[3]) for n, g in got.items()} == {
        "lf": ("utf-8", "auto"), "crlf": ("utf-8", "auto"), "cr": ("utf-8", "cr"), "late": ("windows-1252", "cr"), "late mark +%41": ("windows-1252", "auto"),
        "utf16": ("utf-16le", "cr"), "small": ("utf-8", "auto")}


def test_csv_scan_of_files_that_lines_do_not_settle(spark, tmp_path, monkeypatch):
    from rowloom.sources import dialect
    for name, value in (("WHOLE_FILE", 300), ("LONGEST_LINE", 120), ("HEAD", 200)):
        monkeypatch.setattr(dialect, name, value)
    contents = {
        "long line": b"a,b,c\n1,2,3\n" * 20 + b"x" * 200 + b"\r\n" + b"1,2,3\n" * 20,
        "open quote": b'a,b,c\n"1,2,3\n' + b"1,2,3\n" * 100,
        "blank": b"\n" * 250 + b"a,b,c\n" * 20,
        "both": b"a|b|c\n" * 60 + b"1|2|3\r" * 60,
        "plain": b"name|b c|c\n" + b"1|2|3\n" * 60,
        "packed.gz": b"a,b,c\n1,2,3\n" * 50,
    }
    for name, raw in contents.items():
        put(tmp_path / name, raw)
    got = {r.path.split("/")[-1]: tuple(r) for r in rl.csv_scan(spark, str(tmp_path)).collect()}
    assert got == {name: dialect.scan_bytes(f"file:{tmp_path}/{name}", raw) for name, raw in contents.items()}
    assert got["open quote"][6] == 3 and got["plain"][5] == ["name", "b c", "c"] and got["both"][3] == "cr"

"""Every one-input step: on no rows, and the same result for 1 and 8 partitions."""

import pytest

import rowloom as rl

SCHEMA = "id int, g string, v string, x double, d string"
DATA = [(1, "a", "1", 1.5, "2024-01-02"), (2, "a", "", None, "bad"), (3, "b", None, 2.5, None), (4, None, "x", 4.0, "2024-03-01"),
        (5, "a", "1", 1.5, "2024-01-02"), (6, "", "7", float("nan"), "2023-12-31"), (7, "b", "-2.5", 0.0, "2024-02-29")]

STEPS = {
    "select": rl.select("id,g,none"), "rename": rl.rename("g:h"), "cast": rl.cast("id", "string"),
    "add_column": rl.add_column("y", "x * 2"), "fillna": rl.fillna("9", "v"), "auto_field": rl.auto_field(),
    "data_cleansing": rl.data_cleansing(trim=True, to_upper=True, remove_special=True, nullify_empty=True),
    "find_replace": rl.find_replace("v", "1", "one"), "regex": rl.regex("v", r"(\d)"), "match": rl.regex("v", r"\d", "match"),
    "text_to_columns": rl.text_to_columns("d", "-"), "datetime": rl.datetime("d", "extract", extract="month"),
    "filter": rl.filter_rows("id > 2"), "filter_text": rl.filter_rows("g != 'a'"), "filter_rules": rl.filter_rules([("g", "eq", "a")]),
    "route": rl.route("id > 5, g == 'b'"), "dedup": rl.dedup("g", order_by="id"), "distinct": rl.dedup("g,v,x,d"),
    "last": rl.drop_duplicates("g", "last", "id"), "none": rl.drop_duplicates("v", False),
    "index": rl.drop_duplicates("v", "first", "id", ignore_index=True), "sort": rl.sort("v"), "top": rl.sort("v desc", limit=3),
    "first": rl.sampling("first", 3, order_by="id"), "every": rl.sampling("every", 2, order_by="id"),
    "percent": rl.sampling("percent", 40, key="id"), "row_index": rl.row_index("x desc, id"),
    "ffill": rl.ffill("id", "v,x"), "bfill": rl.bfill("id", "v,x", 1, partition_by="g", hot_rows=2),
    "aggregate": rl.aggregate("g", "SUM(v),AVG(x),COUNT(id)", non_numeric="null"),
    "groupby": rl.groupby("g", "SUM(v) AS s, MEDIAN(id) AS m, FIRST(v) AS f, LAST(d) AS l, NUNIQUE(v) AS n, STD(id) AS sd", order_by="id"),
    "median": rl.groupby("g", "MEDIAN(id) AS m", median_values=1), "pivot": rl.pivot("g", "d", "id", "MAX"),
    "unpivot": rl.unpivot("id,v"), "summary": rl.field_summary(), "frequency": rl.frequency_table("g"),
    "correlation": rl.correlation("id,x"), "regression": rl.regression("id", "v"), "naive_bayes": rl.naive_bayes("id", "g"),
}
COUNTED_ON_EMPTY = {"summary": 5, "correlation": 1}


@pytest.mark.parametrize("name", STEPS)
def test_partitions_and_empty(rows, name):
    step = STEPS[name]
    if name == "distinct":
        step = rl.chain(rl.select("g,v,x,d"), step)
    one, eight = (rows(SCHEMA, *DATA, parts=p).transform(step) for p in (1, 8))
    assert one.columns == eight.columns
    text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert text(one) == text(eight)
    empty = rows(SCHEMA, *DATA).limit(0).transform(step)
    assert empty.count() == COUNTED_ON_EMPTY.get(name, 0)


def test_first_of_a_key_order_keeps_null(rows):
    df = rows("k int, o int, v string, n int", (1, 1, None, None), (1, 2, "b", 5), (1, 3, None, None))
    out = df.transform(rl.groupby("k", "FIRST(v) AS f, LAST(v) AS l, FIRST(n) AS fn, LAST(n) AS ln", order_by="o", unique_order=True))
    assert tuple(out.first()) == (1, None, None, None, None)


def test_rows_are_kept(rows):
    """Both branches, and all outputs of a split, are the input again."""
    df = rows(SCHEMA, *DATA, parts=4)
    yes, no = rl.filter_advanced(df, "x", "gt", "1", "number")
    assert rows.out(rl.union(yes, no), "id") == rows.out(df, "id")
    assert rows.out(rl.union(*rl.split(df, "id > 5, g == 'a', x < 3")), "id") == rows.out(df, "id")
    once = df.transform(rl.dedup("g", order_by="id"))
    assert str(rows.out(once.transform(rl.dedup("g", order_by="id")))) == str(rows.out(once))


def test_registered_queries():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from rowloom.plans.oracle import ORACLE
    from rowloom.plans.queries import QUERIES
    assert set(QUERIES) - set(ORACLE) == {"directory"}
    assert set(QUERIES) <= set(entry.queries())


def test_shared_folder_is_required_on_a_cluster():
    from rowloom.session import shared_dir

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_remove_written(spark, rows):
    from pathlib import Path
    from rowloom.session import _folders, remove_written
    rows("a int", (1,), (2,)).transform(rl.row_index("a")).count()
    paths = [Path(p) for p in _folders if "://" not in p]
    assert any(p.exists() for p in paths)
    assert remove_written(spark) >= 1 and not any(p.exists() for p in paths)

import random

import pytest

import rowloom as rl
from rowloom.plans.checks import plan_of


def reference_fill(values, limit, forward):
    """The rule, one value after the other."""
    out, last, run = [], None, 0
    for v in values if forward else reversed(values):
        if v:
            last, run = v, 0
            out.append(v)
        elif last is not None and (limit is None or run < limit):
            run += 1
            out.append(last)
        else:
            out.append(v)
    return out if forward else out[::-1]


@pytest.mark.parametrize("values, limit, expected", [
    (["A", "", "", "B", ""], None, ["A", "A", "A", "B", "B"]), (["A", "", "", ""], 1, ["A", "A", "", ""])])
def test_ffill(rows, values, limit, expected):
    df = rows("ord int, v string", *enumerate(values))
    assert [r.v for r in df.transform(rl.ffill("ord", "v", limit)).orderBy("ord").collect()] == expected


def test_bfill(rows):
    df = rows("ord int, v string", (1, ""), (2, ""), (3, "Z"), (4, None))
    assert rows.out(df.transform(rl.bfill("ord", "v")), "v") == [(None,), ("Z",), ("Z",), ("Z",)]
    assert df.limit(0).transform(rl.bfill("ord", "v")).count() == 0


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("limit", [None, 2])
@pytest.mark.parametrize("groups, hot_rows", [(None, 1), ("g", 5), ("g", 10**9)])
@pytest.mark.parametrize("parts, stable", [(1, False), (8, False), (8, True)])
def test_fill_against_the_rule(rows, monkeypatch, forward, limit, groups, hot_rows, parts, stable):
    from rowloom.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 5)
    rng = random.Random(5)
    data = []
    for g in ("a", "b", None):  # b is the hot group
        size = {"a": 4, "b": 60, None: 7}[g]
        data += [(g, i, rng.choice(["", "", None, f"v{i}"]), rng.choice([None, float(i)])) for i in range(size)]
    table = [(n, *r) for n, r in enumerate(data)]
    shuffled = table[:]
    rng.shuffle(shuffled)
    df = rows("n int, g string, i int, v string, x double", *shuffled, parts=parts)
    fill = rl.ffill if forward else rl.bfill
    out = {r.n: (r.v, r.x) for r in df.transform(
        fill("n", "v,x", limit, partition_by=groups, stable=stable, hot_rows=hot_rows)).collect()}
    runs = [[r for r in table if r[1] == g] for g in ("a", "b", None)] if groups else [table]
    for run in runs:
        assert [out[r[0]][0] for r in run] == reference_fill([r[3] for r in run], limit, forward)
        xs = reference_fill([None if r[4] is None else f"{r[4]}" for r in run], limit, forward)
        assert [out[r[0]][1] for r in run] == [None if x is None else float(x) for x in xs]


@pytest.mark.parametrize("parts", [1, 8])
def test_row_index(rows, parts):
    data = [(i % 5, f"s{i % 3}") for i in range(200)] + [(2, "copy")] * 100
    df = rows("a int, s string", *data, parts=parts)
    out = df.transform(rl.row_index("a desc"))
    got = sorted((r._index, r.a) for r in out.collect())
    assert [i for i, _ in got] == list(range(300))
    assert [a for _, a in got] == sorted((a for a, _ in data), reverse=True)
    again = sorted((r._index, r.a, r.s) for r in df.repartition(3).transform(rl.row_index("a desc")).collect())
    assert again == sorted((r._index, r.a, r.s) for r in out.collect())
    assert df.limit(0).transform(rl.row_index("a")).count() == 0


def test_copies_are_spread(rows):
    """A group of equal rows does not end up in one range."""
    from rowloom.operators.ordered import numbered, order_keys
    spark = rows("a int", (1,)).sparkSession
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 40000, 1, 8).selectExpr("cast(7 as int) as a", "'same' as s")
        table = numbered(df, order_keys("a", df))
        sizes = [r["count"] for r in table.df.groupBy(table.part()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) >= 6 and max(sizes) < 20000 and sum(sizes) == 40000


def test_no_single_partition(rows):
    df = rows("n int, v string", *[(i, "" if i % 3 else "x") for i in range(50)], parts=8)
    for out in (df.transform(rl.ffill("n", "v", 2)), df.transform(rl.row_index("n")),
                df.transform(rl.sampling("every", 7, order_by="n")), rl.append_fields(df, df, "n", "n")):
        assert "SinglePartition" not in plan_of(out)


def spread_rows(rows, n=3000):
    import datetime as dt
    rng = random.Random(11)
    data = []
    for i in range(n):
        x = rng.choice([rng.gauss(0, 1e3), rng.expovariate(1e-6), None, float("nan"), float("inf"), float("-inf")])
        t = dt.datetime(2024, 3, 9) + dt.timedelta(seconds=rng.randrange(400000))
        data.append((i, x, t, t.date(), rng.choice(["é", "a", "b", "", "zz"]) + str(rng.randrange(99)), rng.choice(["", None, f"v{i}"])))
    return rows("id int, x double, t timestamp_ntz, d date, s string, v string", *data, parts=8), data


@pytest.mark.parametrize("order", ["x, id", "x desc, id desc", "t, id", "d desc, id", "s, id", "s desc, id", "id"])
def test_slices_equal_ranges(rows, monkeypatch, order):
    """The two ways of cutting the order agree, for all kinds of order columns."""
    from rowloom.operators import ordered
    df, _ = spread_rows(rows)
    plain = rows.out(df.transform(rl.row_index(order, unique_order=True)), "id", "_index")
    real = ordered.sliced
    used = []

    def many_slices(df, keys, unique):
        cut = real(df, keys, unique)
        used.append(cut is not None)
        return cut

    monkeypatch.setattr(ordered, "sliced", many_slices)
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 50)
    assert rows.out(df.transform(rl.row_index(order, unique_order=True, stable=True)), "id", "_index") == plain
    assert used == [True]
    for step in (lambda stable: rl.ffill(order, "v", 2, unique_order=True, stable=stable), lambda stable: rl.bfill(order, "v", stable=stable)):
        assert rows.out(df.transform(step(True)), "id", "v") == rows.out(df.transform(step(False)), "id", "v")
    every = rl.sampling("every", 7, order, stable=True)
    assert rows.out(df.transform(every), "id") == rows.out(df.transform(rl.sampling("every", 7, order)), "id")


def test_slices_are_even_or_refused(rows, monkeypatch):
    from rowloom.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 50)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    df, data = spread_rows(rows)
    cut = ordered.sliced(df, [("t", True)])
    sizes = [b - a for a, b in zip(cut.starts, cut.starts[1:] + [len(data)])]
    assert len(sizes) > 8 and sum(sizes) == len(data) and max(sizes) <= 4 * len(data) // 16
    hot = rows("k int, id int", *[(7 if i % 3 else i, i) for i in range(900)])
    assert ordered.sliced(hot, [("k", True)]) is None
    index = hot.transform(rl.row_index("k, id", unique_order=True, stable=True))
    assert [r.id for r in index.orderBy("_index").collect()] == [i for _, i in sorted((7 if i % 3 else i, i) for i in range(900))]
    assert ordered.sliced(df.selectExpr("array(id) as a"), [("a", True)]) is None
    assert df.limit(0).transform(rl.row_index("id", stable=True)).count() == 0


def test_one_shuffle_for_slices(spark, rows, tmp_path, monkeypatch):
    from rowloom.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 50)
    df, _ = spread_rows(rows)
    df.write.parquet(str(tmp_path / "t"))
    plan = plan_of(spark.read.parquet(str(tmp_path / "t")).transform(rl.row_index("t, id", unique_order=True, stable=True)))
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1 and "SinglePartition" not in plan

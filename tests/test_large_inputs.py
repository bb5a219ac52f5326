"""Plans and results that must not depend on how many rows, columns, classes or partitions there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import rowloom as rl
from rowloom.operators import models, ordered, profile, rows as row_steps
from rowloom.plans.checks import plan_of


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_have_a_bounded_size(spark, two_partitions, monkeypatch):
    """A hot key, copies and distinct rows: no range much over the bound, though there are two shuffle partitions."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1000)
    df = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 3 == 0).alias("same"))
    table = ordered.numbered(df, ordered.order_keys("k", df))
    sizes = [r["count"] for r in table.df.groupBy(table.part()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 15 and max(sizes) <= 4000
    out = df.transform(rl.row_index("k")).collect()
    assert sorted(r["_index"] for r in out) == list(range(30_000))
    by_index = [r["k"] for r in sorted(out, key=lambda r: r["_index"])]
    assert by_index == sorted(by_index)


def test_nothing_is_sorted_before_the_exchange(spark, rows):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.lit("x").alias("v"))
    plan = df.transform(rl.sort("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort ") == 1


def test_slices_follow_the_rows(spark, two_partitions, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 500)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 2000)
    df = spark.range(0, 20_000, 1, 4).withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id")))
    cut = ordered.sliced(df, ordered.order_keys("id", df), True)
    sizes = [r["count"] for r in cut.df.groupBy(cut.slice).count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 1000
    assert cut.df.rdd.getNumPartitions() == len(cut.starts)
    filled = df.transform(rl.ffill("id", "v", unique_order=True, stable=True))
    assert filled.where(F.col("v") != F.floor(F.col("id") / 5) * 5).isEmpty()
    assert df.transform(rl.row_index("id", unique_order=True, stable=True)).where("_index != id").isEmpty()


@pytest.mark.parametrize("ranges", [None, 500])
def test_sort_with_a_large_limit(spark, two_partitions, monkeypatch, ranges):
    monkeypatch.setattr(row_steps, "LARGE_LIMIT", 10)
    if ranges:
        monkeypatch.setattr(ordered, "RANGE_ROWS", ranges)
    df = spark.range(0, 5000, 1, 4).select((F.col("id") * 7 % 5000).alias("a"), F.lit("same").alias("s"))
    out = df.transform(rl.sort("a desc", limit=3000))
    assert [r["a"] for r in out.collect()] == list(range(4999, 1999, -1)) and out.columns == ["a", "s"]
    assert [r["a"] for r in df.transform(rl.sort("a")).collect()] == list(range(5000))


def test_two_hundred_columns_in_one_scan(spark, tmp_path):
    """Pairwise complete, far from zero, with constants and columns without values."""
    rng = np.random.default_rng(1)
    values = rng.normal(size=(400, 200)) * 10.0 ** rng.integers(-3, 4, 200) + rng.choice([0, 1e9, -1e6], 200)
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:, 3], values[:, 4] = 5.0, np.nan
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in values], ", ".join(f"{n} double" for n in names)).repartition(5)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = profile.moments(df, [0.0] * 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {(r.col1, r.col2): r.pearson for r in df.transform(rl.correlation(digits=None)).collect()}
    assert len(got) == 199 * 100
    some = [(0, 1), (2, 3), (4, 5), *[tuple(sorted(rng.choice(200, 2, replace=False))) for _ in range(60)]]
    for i, j in some:
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        x, y = values[both, i], values[both, j]
        want = np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() and y.std() else 0.0
        assert got[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-9), (i, j)
    few = df.select("c0", "c1", "c2", "c3")
    plain = {(r.col1, r.col2): r.pearson for r in few.transform(rl.correlation(digits=None)).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in plain.items())  # Spark's own sums lose digits at 1e9


def test_an_origin_far_from_the_mean(spark):
    """The first value is no guide to the others; the sums are taken again from the means."""
    df = spark.range(0, 3000, 1, 1).select(*[F.when(F.col("id") == 0, 0.0).when(F.col("id") > 0, 1e9 + (F.col("id") * (i + 1) % 17)).alias(f"c{i}") for i in range(15)])
    later = df.where("c0 > 1")
    got = {(r.col1, r.col2): r.pearson for r in profile._by_blocks(later, later.columns, None).collect()}
    want = np.corrcoef(np.array(later.collect()).T)
    assert all(got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(15) for j in range(i + 1, 15))


def test_ten_thousand_classes_in_one_job(spark, monkeypatch):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 10_000).alias("c"), (F.col("id") % 10_000 * 3.0 + F.col("id") % 2).alias("x"))
    out = df.transform(rl.naive_bayes("x", "c", "likely"))
    plan = plan_of(out)
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and len(plan) < 5000
    assert dict(out.dtypes)["likely"] == "bigint" and out.where("likely = c").count() > 39_000
    few = df.where("c < 200")
    want = few.transform(rl.naive_bayes("x", "c", "likely")).orderBy("c", "x").collect()
    monkeypatch.setattr(models, "CLASSES_PER_EXPRESSION", 1000)
    assert few.transform(rl.naive_bayes("x", "c", "likely")).orderBy("c", "x").collect() == want
    monkeypatch.setattr(models, "CLASSES_PER_EXPRESSION", 64)
    monkeypatch.setattr(models, "MODEL_NUMBERS", 210)  # 70 classes a part
    assert few.transform(rl.naive_bayes("x", "c", "likely")).orderBy("c", "x").collect() == want


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("flip", [False, True])
def test_large_keys_match_exactly(rows, how, flip):
    big = 2 ** 53
    ints = rows("k bigint, a int", (big, 1), (big + 1, 2), (3, 3), (None, 4))
    floats = rows("k2 double, b int", (float(big), 10), (3.0, 30), (3.5, 35), (float("nan"), 0), (None, 40))
    left, lk, right, rk = (floats, "k2", ints, "k") if flip else (ints, "k", floats, "k2")
    out = rl.join(left, right, lk, rk, how)
    if how == "inner":
        found = {(r["a"], r["b"]) for r in out.collect()}
        assert found == {(1, 10), (3, 30), (4, 40)}
    elif how == "full" or (how == "left") != flip:  # 2**53 + 1 would have to be given out as a double
        with pytest.raises(Exception, match="9007199254740993"):
            out.collect()
    else:
        assert {(r["a"], r["b"]) for r in out.collect()} == {(1, 10), (3, 30), (4, 40), (None, 35), (None, 0)}


def test_json_types_are_strict(rows):
    df = rows("body string", ('[{"a":"x","b":1}]',))
    with pytest.raises(Exception, match="(?i)malformed"):
        rl.explode_records(df, "body", "a bigint, b int").collect()
    assert rows.out(rl.explode_records(df, "body", "a bigint, b int", errors="null")) == [(None, 1)]

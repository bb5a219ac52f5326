"""Sketches against exact numbers, and a union of stored sketches against one over all rows."""

import pytest
from pyspark.sql import functions as F

import rowloom as rl

SPEC = "NUNIQUE(u) AS users, MEDIAN(x) AS mid"


def test_union_of_stored_sketches(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 2).alias("g"), (F.col("id") % 9_000).alias("u"),
                                             F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 10_007).cast("double")).alias("x"))
    for i in range(3):
        df.where(F.col("id") % 3 == i if "id" in df.columns else F.col("u") % 3 == i).transform(rl.sketch_groups("g", SPEC, non_numeric="null")).write.parquet(str(tmp_path / f"part={i}"))
    stored = spark.read.parquet(str(tmp_path))
    merged = stored.transform(rl.chain(rl.merge_sketches("g", SPEC), rl.estimate_sketches(SPEC))).orderBy("g").collect()
    whole = df.transform(rl.chain(rl.sketch_groups("g", SPEC, non_numeric="null"), rl.estimate_sketches(SPEC))).orderBy("g").collect()
    for a, b in zip(merged, whole, strict=True):
        assert a["users"] == b["users"] and abs(a["users"] - 4500) < 3 * 0.0163 * 4500
        assert abs(a["mid"] - 5003) < 0.02 * 10_007 and abs(b["mid"] - 5003) < 0.02 * 10_007
    low = stored.transform(rl.chain(rl.merge_sketches((), SPEC), rl.estimate_sketches(SPEC, share=0.1))).first()
    assert abs(low["mid"] - 1000) < 250 and abs(low["users"] - 9000) < 450


def test_odd_values(rows):
    df = rows("g string, u string, x double", ("a", None, None), ("a", "", float("nan")), ("a", "x", None), (None, "y", 2.0))
    out = rows.out(df.transform(rl.chain(rl.sketch_groups("g", SPEC, non_numeric="null"), rl.estimate_sketches(SPEC))), "g", "users", "mid")
    assert out == [(None, 1, 2.0), ("a", 3, None)]
    assert df.where("false").transform(rl.sketch_groups("g", SPEC)).count() == 0
    with pytest.raises(ValueError):
        rl.sketch_groups("g", "SUM(x)")
    with pytest.raises(ValueError):
        rl.estimate_sketches(SPEC, share=2)


def test_mixed_columns_keep_each_value_s_type(rows):
    df = rows("a string, b string", ("1", "5"), ("+2.50", "6"), ("TRUE", ""), ("x y", None), ("", "7"), (None, "8"), ("99999999999999999999", "9"), ("0", "1"))
    out = df.transform(rl.auto_field(mixed="variant"))
    assert dict(out.dtypes) == {"a": "variant", "b": "int"} or dict(out.dtypes)["b"] == "bigint"
    kinds = rows.out(out.select(F.schema_of_variant("a").alias("k"), F.col("a").cast("string").alias("v")))
    assert sorted((k or "", v or "") for k, v in kinds) == sorted([
        ("BIGINT", "1"), ("DOUBLE", "2.5"), ("BOOLEAN", "true"), ("STRING", "x y"), ("STRING", ""), ("", ""), ("DOUBLE", "1.0E20"), ("BIGINT", "0")])
    assert dict(df.transform(rl.auto_field()).dtypes)["a"] == "string"
    with pytest.raises(ValueError):
        rl.auto_field(mixed="json")

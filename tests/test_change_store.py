"""The bucketed change store against a plain replay of the changes."""

import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom.streaming import store as stores
from rowloom.streaming.store import ChangeStore, store_change_stream
from rowloom.streaming.streams import apply_change_stream, read_folder, read_snapshot

SCHEMA = "seq int, _op string, k int, v string"


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def replay(start, batches):
    """Key -> value after all batches; the greatest sequence counts, of equal ones the first that came."""
    seen, rows = {}, dict(start)
    for batch in batches:
        last = {}
        for change in batch:
            if change[2] not in last or (change[0] or -1) > (last[change[2]][0] or -1):
                last[change[2]] = change
        for seq, op, k, v in last.values():
            if k not in seen or seq > seen[k]:
                seen[k] = seq
                rows.pop(k, None)
                if op.upper() != "DELETE":
                    rows[k] = v
    return rows


@pytest.mark.parametrize("buckets,fan,least", [(1, 8, 10_000), (5, 2, 3)])
def test_store_equals_replay(spark, rows, tmp_path, monkeypatch, buckets, fan, least):
    """Small limits make every batch merge deltas or rewrite buckets."""
    monkeypatch.setattr(stores, "FAN", fan)
    monkeypatch.setattr(stores, "LEAST_PENDING", least)
    random.seed(buckets)
    start = [(k, f"start {k}") for k in range(12)] + [(None, "no key")]
    store = ChangeStore.create(rows("k int, v string", *start), str(tmp_path / "s"), "k", "int", buckets)
    sequences = random.sample(range(1000), 60)
    batches = []
    for i in range(6):
        batch = [(sequences.pop(), random.choice(["INSERT", "update", "DELETE"]), random.choice([*range(15), None]), f"v{i}") for _ in range(random.randint(1, 6))]
        batches.append(batch)
        assert store.apply(rows(SCHEMA, *batch, parts=2), "seq")
        if i == 3:
            assert rows.out(store.read()) == rows.out(spark.createDataFrame(list(replay(start, batches).items()) or [], "k int, v string"))
    at = store.manifest()
    assert at.version == 6 and len(at.deltas) <= fan * 4
    store.compact()
    assert not store.manifest().deltas and not any(store.manifest().pending)
    want = rows.out(spark.createDataFrame(list(replay(start, batches).items()), "k int, v string"))
    assert rows.out(store.read()) == want
    store.rebucket(3)
    assert len(store.manifest().folder) == 3 and rows.out(store.read()) == want
    late = [(-1, "INSERT", k, "late") for k in range(15)]
    store.apply(rows(SCHEMA, *late), "seq")
    assert rows.out(store.read()) == rows.out(spark.createDataFrame(list(replay(start, [*batches, late]).items()), "k int, v string"))


def test_bytes_follow_the_batch(spark, rows, tmp_path):
    """One changed key in a million rows writes some kilobytes and leaves every bucket's files alone."""
    path = tmp_path / "s"
    big = spark.range(1_000_000).select(F.col("id").cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    store = ChangeStore.create(big, str(path), "k", "int", 16)
    before, files = size(path), {p for p in path.rglob("*.parquet") if "/base-" in str(p)}
    assert before > 10_000_000 and len(store.manifest().folder) == 16
    for i in range(10):
        store.apply(rows(SCHEMA, (i, "UPDATE", 77, f"new {i}")), "seq")
        assert files <= set(path.rglob("*.parquet"))
    assert size(path) - before < 100_000
    assert store.read().where("k = 77").collect()[0]["v"] == "new 9" and store.read().count() == 1_000_000


def test_only_full_buckets_are_rewritten(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "LEAST_PENDING", 100)
    store = ChangeStore.create(spark.range(4000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v")), str(tmp_path / "s"), "k", "int", 8)
    at = store.manifest()
    hot = store._base(at, [3]).select("k").limit(260)
    store.apply(hot.select(F.lit(1).alias("seq"), F.lit("UPDATE").alias("_op"), "k", F.lit("b").alias("v")), "seq")
    now = store.manifest()
    assert [b for b in range(8) if now.folder[b] != at.folder[b]] == [3] and now.pending[3] == 0 and now.upto[3] == 1 and not now.deltas
    assert store.read().where("v = 'b'").count() == 260 and store.read().count() == 4000


def test_failed_and_repeated_batches(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store = ChangeStore.create(rows("k int, v string", (1, "a"), (2, "b")), path, "k", "int")
    good = rows(SCHEMA, (1, "UPDATE", 1, "x"))
    assert store.apply(good, "seq", stream="one", batch=0)
    assert not store.apply(good, "seq", stream="one", batch=0)
    with pytest.raises(PySparkException, match="must be one of"):
        store.apply(rows(SCHEMA, (2, "UPDATE", 2, "y"), (3, "UPSERT", 1, "z")), "seq", stream="one", batch=1)
    assert rows.out(store.read()) == [(1, "x"), (2, "b")] and store.manifest().version == 1
    Path(path, "manifest", f"{2:020d}").mkdir()  # as a driver that was lost while it wrote
    assert store.manifest().version == 1
    assert store.apply(rows(SCHEMA, (2, "DELETE", 2, None)), "seq", stream="one", batch=1)
    assert rows.out(store.read()) == [(1, "x")] and store.manifest().streams == {"one": 1}
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.manifest())
    with pytest.raises(ValueError, match="already"):
        ChangeStore.create(rows("k int, v string", (1, "a")), path, "k", "int")
    with pytest.raises(ValueError, match="no store"):
        ChangeStore(spark, str(tmp_path / "none")).read()
    with pytest.raises(ValueError, match="buckets"):
        ChangeStore.create(rows("k int, v string", (1, "a")), str(tmp_path / "t"), "k", "int", 0)
    kept = [p.name for p in (tmp_path / "s" / "manifest").iterdir()]
    assert sorted(kept) == [f"{1:020d}", f"{2:020d}"]


def test_empty_store_and_empty_batch(rows, tmp_path):
    store = ChangeStore.create(rows("k int, v string").where("false"), str(tmp_path / "s"), "k", "int", 4)
    assert store.read().count() == 0
    store.apply(rows(SCHEMA, (1, "INSERT", 1, "x")).where("false"), "seq")
    assert store.read().count() == 0 and not store.manifest().deltas
    store.apply(rows(SCHEMA, (None, "INSERT", 1, "x")), "seq")
    store.apply(rows(SCHEMA, (None, "INSERT", 1, "y")), "seq")
    assert rows.out(store.read()) == [(1, "y")]
    store.apply(rows(SCHEMA, (0, "INSERT", 1, "z")), "seq")
    store.compact()
    store.apply(rows(SCHEMA, (None, "INSERT", 1, "old"), (0, "INSERT", 1, "equal")), "seq")
    assert rows.out(store.read()) == [(1, "z")]


FIRST = [(1, "UPDATE", 1, "one"), (2, "UPDATE", 2, "two")]
SECOND = [(3, "UPDATE", 3, "three"), (4, "DELETE", 2, None)]


@pytest.mark.parametrize("kind", ["store", "snapshot"])
def test_a_second_stream_goes_on_from_the_newest_version(spark, rows, tmp_path, kind):
    """A new checkpoint on the same table keeps all earlier changes."""
    start, path = rows("k int, v string", (1, "a"), (2, "b"), (3, "c")), str(tmp_path / "s")
    if kind == "store":
        store = ChangeStore.create(start, path, "k", "int", 2)
    else:
        start.write.parquet(f"{path}/version=start")
    for i, part in enumerate((FIRST, SECOND)):
        rows(SCHEMA, *part).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        for _ in range(2):  # the second run finds nothing new
            stream, checkpoint = read_folder(spark, str(tmp_path / f"in{i}"), SCHEMA), str(tmp_path / f"cp{i}")
            if kind == "store":
                query = store_change_stream(stream, store, "seq", checkpoint, available_now=True)
            else:
                query = apply_change_stream(stream, path, "k", "seq", checkpoint, available_now=True)
            query.awaitTermination()
    out = store.read() if kind == "store" else read_snapshot(spark, path)
    assert rows.out(out) == [(1, "one"), (3, "three")]
    if kind == "store":
        assert len(store.manifest().streams) == 2
        with pytest.raises(ValueError):
            store_change_stream(stream, store, "seq", "")

import datetime as dt
import random

import pytest

import rowloom as rl
from rowloom.session import new_folder
from rowloom.streaming.streams import apply_change_stream, lookup_join, per_batch, read_folder, read_snapshot, run_available, stream_dedup

CHANGES = [(1, "INSERT", 4, "new"), (2, "UPDATE", 1, "one"), (3, "DELETE", 2, None), (4, "UPDATE", 4, "newer"), (5, "INSERT", 2, "again"),
           (6, "DELETE", 3, None)]


@pytest.mark.parametrize("parts", [1, 8])
def test_apply_changes(rows, parts):
    snapshot = rows("k int, v string", (1, "a"), (2, "b"), (3, "c"), (9, "z"), parts=parts)
    changes = rows("seq int, _op string, k int, v string", *CHANGES, parts=parts)
    assert rows.out(rl.apply_changes(snapshot, changes, "k", "seq")) == [(1, "one"), (2, "again"), (4, "newer"), (9, "z")]
    assert rl.last_changes(changes, "k", "seq").count() == 4
    assert rows.out(rl.upsert(snapshot, rows("k int, v string", (1, "x"), (5, "y")), "k"))[0] == (1, "x")


def test_change_stream(spark, rows, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "snap")
    rows("k int, v string", (1, "a"), (2, "b"), (3, "c"), (9, "z")).write.parquet(f"{state}/version=start")
    schema = "seq int, _op string, k int, v string"
    for part in (CHANGES[:3], CHANGES[3:]):
        rows(schema, *part).coalesce(1).write.mode("append").parquet(folder)
        stream = read_folder(spark, folder, schema)
        apply_change_stream(stream, state, "k", "seq", checkpoint=str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows.out(read_snapshot(spark, state)) == [(1, "one"), (2, "again"), (4, "newer"), (9, "z")]


@pytest.mark.parametrize("seed", range(3))
def test_change_stream_keeps_order_over_batches(spark, rows, tmp_path, seed):
    folder, state = str(tmp_path / "in"), str(tmp_path / "snap")
    rows("k int, v string", (1, "a"), (2, "b"), (3, "c"), (9, "z")).write.parquet(f"{state}/version=start")
    schema = "seq int, _op string, k int, v string"
    for change in random.Random(seed).sample([*CHANGES, (0, "DELETE", 4, None)], 7):
        rows(schema, change).coalesce(1).write.mode("append").parquet(folder)
    stream = read_folder(spark, folder, schema, files_per_trigger=1)
    apply_change_stream(stream, state, "k", "seq", str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows.out(read_snapshot(spark, state)) == [(1, "one"), (2, "again"), (4, "newer"), (9, "z")]
    kept = sorted(p.name for p in (tmp_path / "snap").glob("version=*"))
    assert kept == ["version=5", "version=6", "version=start"]
    with pytest.raises(ValueError):
        apply_change_stream(stream, state, "k", "seq", "")


def test_stateless_steps_on_a_stream(spark, rows, tmp_path):
    schema = "id int, name string, amount string, d string"
    rows(schema, (1, " A ", "10", "2024-01-02"), (2, "B", "", "x"), (3, None, "30", None)).write.parquet(str(tmp_path / "in"))
    step = rl.chain(
        rl.rename("name:label"), rl.fillna("0", "amount"), rl.cast("amount", "float"), rl.add_column("twice", "amount * 2"),
        rl.data_cleansing("label", trim=True, to_lower=True), rl.find_replace("label", "a", "z"), rl.regex("d", r"^(\d+)", output="y"),
        rl.text_to_columns("d", "-", max_split=3), rl.datetime("d", output_format="02/01/2006"), rl.route("amount > 5"),
        rl.filter_rows("twice >= 0"), rl.select("id,label,amount,twice,y,d_2,d,_route"))
    batch = spark.read.parquet(str(tmp_path / "in")).transform(step)
    stream = read_folder(spark, str(tmp_path / "in"), schema)
    assert stream.isStreaming
    assert rows.out(run_available(stream.transform(step))) == rows.out(batch)
    both = rl.union(stream.select("id", "name"), stream.select("id", "amount"))
    assert run_available(both).count() == 6
    tall = stream.transform(rl.unpivot("name,amount,d"))
    assert run_available(tall).count() == 9
    yes, no = rl.filter_advanced(stream, "amount", "is_null")
    assert run_available(yes).count() + run_available(no).count() == 3


def test_stream_dedup_and_lookup(spark, rows, tmp_path):
    schema = "id int, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    rows(schema, (1, t), (1, t), (2, t + dt.timedelta(minutes=1))).write.parquet(str(tmp_path / "in"))
    stream = read_folder(spark, str(tmp_path / "in"), schema)
    assert run_available(stream_dedup(stream, "id", "ts")).count() == 2
    table = rows("id int, label string", (1, "one"))
    assert rows.out(run_available(lookup_join(stream, table, "id", "id", "left")), "id", "label") == [(1, "one"), (1, "one"), (2, None)]
    with pytest.raises(ValueError):
        lookup_join(stream, table, "id", "id", "full")
    out = new_folder(spark, "batches")
    query = stream.writeStream.foreachBatch(per_batch(rl.groupby("id", "COUNT(ts) AS n"), out)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows.out(spark.read.parquet(out), "id", "n") == [(1, 2), (2, 1)]

import json

import pytest
from pyspark.sql import functions as F

from tidegrid.errors import InvalidFields, InvalidParams, InvalidTime, ReadOnly
from tidegrid.operators import rollup
from tidegrid.params import Params
from tidegrid.sources.store import MetricStore, load_all
from tidegrid.streaming.track import track_stream

P0 = Params.of("1h", "1m", "10h", 2, 2)
R, D = P0.resolution, P0.duration
SCHEMA = "ts_ns long, fields array<string>, total double, count double"


def points(df):
    return sorted((r.epoch, "/".join(r.fields), r.pos, r.total, r["count"]) for r in df.collect())


def test_load_all(spark, tmp_path, capsys):
    good = {"duration": "1h", "resolution": "1m", "retention": "24h", "maxROEpochs": 10, "maxRWEpochs": 3}
    for name, text in (("db1", json.dumps(good)), ("db2", ""), ("db3", json.dumps(good | {"resolution": "31m"})), ("db4", json.dumps(good | {"maxRWEpochs": 0}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "params.json").write_text(text)
    (tmp_path / "db5").mkdir()
    (tmp_path / "file").write_text("x")
    found = load_all(spark, f"file://{tmp_path}")
    assert list(found) == ["db1"]
    assert "db3 is left out" in capsys.readouterr().out
    assert load_all(spark, f"file://{tmp_path}/none") is None


def test_track_fetch_reopen_expire_compact(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    assert store.fetch(0, D, ["a"]).count() == 0
    rows = [(0, ["a", "b"], 5.0, 1.0), (R, ["a", "c"], 5.0, 2.0), (D, ["a", "b"], 1.0, 1.0), (3 * D, ["z"], 1.0, 1.0)]
    store.track(spark.createDataFrame(rows, SCHEMA))
    store.track(spark.createDataFrame([(0, ["a", "b"], 2.0, 1.0)], SCHEMA))
    again = load_all(spark, f"file://{tmp_path}")["db"]
    want = [(0, "a/b", 0, 7.0, 2.0), (0, "a/b", 1, 0.0, 0.0), (0, "a/c", 0, 0.0, 0.0), (0, "a/c", 1, 5.0, 2.0)]
    assert points(again.fetch(0, 2 * R, ["a", "*"])) == want
    assert again.epochs() == [0, D, 3 * D]
    assert again.compact() and again.compact() is None
    assert points(again.fetch(0, 2 * R, ["a", "*"])) == want
    assert {r.batch[0] for r in again.cells().where("epoch = 0").select("batch").distinct().collect()} == {"c"}
    assert [len(r.series) for r in again.fetch_chunks(0, 4 * D, ["*"]).collect()] == [1, 1, 0, 1]
    assert points(again.fetch(0, 4 * D, ["*"], now=13 * D).where("total > 0")) == [(3 * D, "z", 0, 1.0, 1.0)]
    assert again.series(0, D, ["a", "*"]).count() == 2 and again.fetch_sparse(0, D, ["a", "*"]).count() == 2
    assert again.expire(D + 1) == [0, D] and again.epochs() == [3 * D]
    assert again.expire_retention(100 * D) == [3 * D]
    for bad, error in (((5, 1, ["a"]), InvalidTime), ((0, D, []), InvalidFields), ((0, D, ["a", ""]), InvalidFields)):
        with pytest.raises(error):
            again.fetch(*bad)
    with pytest.raises(InvalidParams):
        MetricStore.open(spark, f"file://{tmp_path}/db", Params.of("2h", "1m", "10h"))
    with pytest.raises(InvalidParams):
        MetricStore.open(spark, f"file://{tmp_path}/other", None)


def test_broken_compaction_and_repeated_batch(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    rows = spark.createDataFrame([(0, ["a"], 1.0, 1.0)], SCHEMA)
    store.write_batch(rows, "s-1")
    store.write_batch(rows, "s-1")  # a retry replaces
    store.write_batch(rows, "s-2")
    assert points(store.fetch(0, R, ["a"])) == [(0, "a", 0, 2.0, 2.0)]
    store.files.write(f"{store.path}/compactions/c-x.pending", json.dumps({0: ["c-x"]}))
    store._put(rollup.rollup(rows, P0), "c-x")
    assert points(store.fetch(0, R, ["a"])) == [(0, "a", 0, 2.0, 2.0)]
    store.files.write(f"{store.path}/compactions/c-x.done", json.dumps({0: ["s-1", "s-2"]}))
    assert points(store.fetch(0, R, ["a"])) == [(0, "a", 0, 1.0, 1.0)]


def test_stream(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    rows = spark.createDataFrame([(i * R, ["a", str(i % 3)], 1.0, 1.0) for i in range(90)], SCHEMA)
    for part in (0, 1):
        rows.where(F.col("ts_ns") / R % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        track_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint", once=True)
        store.sync()
        store.streams[-1].awaitTermination()
    own = sorted(map(str, rollup.rollup(rows, P0).select("epoch", "fields", "bucket", "total", "count").collect()))
    assert sorted(map(str, rollup.summed(store.cells()).collect())) == own
    store.close()


def test_replay_after_compaction(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    rows = spark.createDataFrame([(0, ["a"], 1.0, 1.0), (D, ["a"], 1.0, 1.0)], SCHEMA)
    for name in ("s-1", "s-2", "s-x-1"):
        store.write_batch(rows, name)
    assert store.compact([0])
    for _ in range(2):
        store.write_batch(rows, "s-2")
        store.write_batch(rows, "s-x-1")
        assert points(store.fetch(0, D + R, ["a"]).where("total > 0")) == [(0, "a", 0, 3.0, 3.0), (D, "a", 0, 3.0, 3.0)]
        store.vacuum()
    assert store.files.folders(f"{store.path}/cells/epoch=0")[0].startswith("batch=c-") and len(store.files.folders(f"{store.path}/cells/epoch=0")) == 1
    store.write_batch(rows, "s-3")
    assert store.compact() and store.compact() is None
    for name in ("s-3", "s-x-1"):
        store.write_batch(rows, name)
    assert points(store.fetch(0, D + R, ["a"]).where("total > 0")) == [(0, "a", 0, 4.0, 4.0), (D, "a", 0, 4.0, 4.0)]


def test_readers_outlive_a_compaction(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    rows = spark.createDataFrame([(0, ["a"], 1.0, 1.0)], SCHEMA)
    store.track(rows)
    store.track(rows)
    before = store.fetch(0, R, ["a"])
    before.explain()  # planned, files listed
    store.compact()
    assert points(before) == [(0, "a", 0, 2.0, 2.0)]


def test_two_streams_and_a_new_checkpoint(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    for k in range(3):
        spark.createDataFrame([(0, ["a"], 1.0, 1.0)], SCHEMA).write.parquet(f"{tmp_path}/in{k}")
        track_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in{k}"), store, f"{tmp_path}/checkpoint{k}", once=True).awaitTermination()
    assert points(store.fetch(0, R, ["a"])) == [(0, "a", 0, 3.0, 3.0)]


def test_read_only_and_delivery(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    rows = spark.createDataFrame([(0, ["a", "b"], 1.0, 1.0), (2 * D + R, ["a", "c"], 2.0, 1.0)], SCHEMA)
    store.track(rows)
    reader = load_all(spark, f"file://{tmp_path}", read_only=True)["db"]
    for write in (lambda: reader.track(rows), lambda: reader.write_batch(rows, "s-1"), lambda: reader.expire(D), reader.compact, reader.vacuum):
        with pytest.raises(ReadOnly):
            write()
    got = []
    reader.deliver(0, 2 * D + 2 * R, ["a", "*"], lambda lo, hi, series: got.append((lo, hi, [("/".join(f), [(p.total, p["count"]) for p in x][:2]) for f, x in series])))
    assert got == [(0, D, [("a/b", [(1.0, 1.0), (0.0, 0.0)])]), (D, 2 * D, []), (2 * D, 2 * D + 2 * R, [("a/c", [(0.0, 0.0), (2.0, 1.0)])])]
    assert points(reader.fetch(0, R, ["a", "*"])) == [(0, "a/b", 0, 1.0, 1.0)]


def test_files_are_replaced_whole(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    for text in ("one", "two"):
        store.files.write(f"{store.path}/x/y", text)
        assert store.files.read(f"{store.path}/x/y") == text
    assert store.files.files(f"{store.path}/x") in (["y"], [".y.crc", "y"])


def test_reader_sees_later_writes(spark, tmp_path):
    store = MetricStore.open(spark, f"file://{tmp_path}/db", P0)
    store.sync()
    store.close()
    reader = load_all(spark, f"file://{tmp_path}", read_only=True)["db"]
    assert reader.fetch(0, R, ["a"]).count() == 0
    store.track(spark.createDataFrame([(0, ["a"], 1.0, 1.0)], SCHEMA))
    assert points(reader.fetch(0, R, ["a"])) == [(0, "a", 0, 1.0, 1.0)]
    assert [b.name for b in (tmp_path / "db" / "cells").iterdir() if b.name.startswith("epoch")] == ["epoch=0"]

"""Events that come newest first: few micro-batches, however many events."""

from datetime import datetime

from pyspark.sql import functions as F

from tidegrid.operators import rollup
from tidegrid.plans import adapters, catalog
from tidegrid.sources.store import MetricStore


def events(spark, path, n):
    rows = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64("id"), F.lit(20 * 86400))).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"),
        F.lit(1.0).alias("value"),
    )
    rows.write.parquet(f"{path}/events.parquet")


def tracked(spark, path, monkeypatch):
    """The first and last time of every micro-batch, in the order in which they came, and the rows."""
    spans, put = [], MetricStore.write_batch

    def noted(store, rows, batch):
        spans.append(tuple(rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()))
        return put(store, rows, batch)

    monkeypatch.setattr(MetricStore, "write_batch", noted)
    return sorted(map(tuple, catalog.stream_out_of_order(spark, path).collect())), spans


def test_few_batches_newest_first(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    events(spark, path, 50_000)
    got, spans = tracked(spark, path, monkeypatch)
    assert 4 <= len(spans) <= 8
    assert all(later[0] > earlier[1] for later, earlier in zip(spans, spans[1:], strict=False))
    cells = rollup.rollup(rollup.measurements(adapters.e1(spark, path)), adapters.HOURLY).where("depth = 2")
    assert got == sorted(map(tuple, catalog.listed(cells).collect())) and sum(r[-1] for r in got) == 50_000


def test_one_time_and_no_events(spark, tmp_path, monkeypatch):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for name, rows in (("one", [(i, datetime(2024, 1, 2), 3, "view", 2.0) for i in range(5)]), ("none", [])):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
        got, spans = tracked(spark, path, monkeypatch)
        assert [r[0] for r in got] == ["view/3"] * bool(rows) and len(spans) == bool(rows) and sum(r[-1] for r in got) == len(rows)
        monkeypatch.undo()

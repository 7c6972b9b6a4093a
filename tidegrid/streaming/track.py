"""Streams of measurements: exactly-once deltas into a store, and windowed rollups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.operators.rollup import measurements
from tidegrid.params import Params
from tidegrid.sources.store import MetricStore


def track_stream(events: DataFrame, store: MetricStore, checkpoint: str, name: str | None = None, once: bool = False, interval: str | None = None, drop_invalid: bool = False) -> StreamingQuery:
    """Tracks a stream of (ts_ns, fields, total, count) into a store.

    Every micro-batch is written as a batch of its own, named by the query's id, which its checkpoint keeps, and its number:
    a repeated micro-batch replaces itself, or what of it a compaction has not taken in yet, and streams never replace each
    other's. There is no watermark, so rows count however late they come. name: what the query is called while it runs.
    once: reads what is there and ends.
    """
    known: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        if not known:
            known.append(json.loads(store.files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"])
        store.write_batch(measurements(rows, drop_invalid), f"s-{known[0]}-{number:012d}")

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if name:
        writer = writer.queryName(f"track-{name}")
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    query = writer.start()
    store.streams.append(query)
    return query


def windowed(events: DataFrame, params: Params, late: str | None = None) -> DataFrame:
    """(bucket, fields, total, count) of every prefix, as a streaming aggregate over (ts, fields, total, count).

    ts is a timestamp; the resolution must be whole microseconds. With a delay `late`, state older than the watermark is
    dropped and later rows don't count; without, all state is kept.
    """
    if late:
        events = events.withWatermark("ts", late)
    ups = F.transform(F.sequence(F.lit(1), F.size("fields")), lambda i: F.slice("fields", 1, i))
    rows = events.where(F.size("fields") > 0).select("ts", F.explode(ups).alias("fields"), "total", "count")
    window = F.window("ts", f"{params.resolution // 1000} microseconds")  # grouped by the struct: its start alone would keep all state
    sums = rows.groupBy(window.alias("window"), "fields").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    return sums.select((F.unix_micros("window.start") * 1000).alias("bucket"), "fields", "total", "count")

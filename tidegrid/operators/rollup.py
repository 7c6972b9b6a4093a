"""Rollups of measurements to every prefix of their field path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.paths import checked_pattern, matches, prefix, valid_fields
from tidegrid.functions.timeaxis import Range, bucket_of, epoch_of, ns_within
from tidegrid.params import Params


def measurements(events: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """(ts_ns, fields, total, count), ready to be tracked.

    Rows without fields are no measurements and left out. Other rows that can't be stored stop the job as it reads them, or
    are left out on demand: a null or negative time, a null measure, a path with a null, empty or wildcard element.
    """
    rows, timed, named, measured = _checked(events)
    if drop_invalid:
        return rows.where(timed & named & measured)
    failed = lambda text: F.raise_error(F.lit(text))
    return rows.withColumn("ts_ns", F.when(~timed, failed("invalid timestamp")).when(~named, failed("invalid fields")).when(~measured, failed("a measure is null")).otherwise(F.col("ts_ns")).cast("long"))


def _checked(events: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """The rows with fields, and whether their time, path and measures are valid."""
    rows = events.select(F.col("ts_ns").cast("long"), "fields", F.col("total").cast("double"), F.col("count").cast("double"))
    rows = rows.where(F.col("fields").isNotNull() & (F.size("fields") > 0))
    return rows, F.coalesce(F.col("ts_ns") >= 0, F.lit(False)), valid_fields(F.col("fields")), F.col("total").isNotNull() & F.col("count").isNotNull()


def rejected(events: DataFrame) -> DataFrame:
    """(ts_ns, fields, total, count, reason): the rows that measurements() leaves out on demand, to be counted or looked into."""
    rows, timed, named, measured = _checked(events)
    reason = F.when(~timed, "invalid timestamp").when(~named, "invalid fields").when(~measured, "a measure is null")
    return rows.withColumn("reason", reason).where("reason is not null")


def bucketed(rows: DataFrame, params: Params) -> DataFrame:
    """rows with epoch and bucket: the starts, in nanoseconds, of the time partition and of the point they fall in."""
    return rows.withColumns({"epoch": epoch_of(F.col("ts_ns"), params), "bucket": bucket_of(F.col("ts_ns"), params)})


def summed(cells: DataFrame, *more: str) -> DataFrame:
    return cells.groupBy("epoch", "fields", "bucket", *more).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


def rollup(events: DataFrame, params: Params) -> DataFrame:
    """(epoch, depth, f0, fields, bucket, total, count): the sums of every non-empty prefix in every bucket.

    There is no grand total. Rows of the same cell are combined before the shuffle, so a path that most rows share is no
    hot key. depth and f0 repeat what fields holds, in columns that Parquet can filter by.
    """
    rows = bucketed(events, params)
    ups = F.transform(F.sequence(F.lit(1), F.size("fields")), lambda i: F.slice("fields", 1, i))
    exploded = rows.where(F.size("fields") > 0).select("epoch", "bucket", F.explode(ups).alias("fields"), "total", "count")
    return with_keys(summed(exploded))


def with_keys(cells: DataFrame) -> DataFrame:
    return cells.select("epoch", F.size("fields").alias("depth"), F.get("fields", F.lit(0)).alias("f0"), "fields", "bucket", "total", "count")


def rollup_at(events: DataFrame, params: Params, pattern: Sequence[str], span: Range | None = None) -> DataFrame:
    """The rollup's cells that match a pattern, straight from events: one row in, one row into the sums.

    Equal to filtering rollup(), without making the other levels; the pattern is applied below the aggregate, and so are
    the bounds of the epochs that a range touches, down to the scan where ts_ns is a stored column.
    """
    pattern = checked_pattern(pattern)
    if span is not None:
        events = events.where(ns_within(F.col("ts_ns"), span, params))
    rows = bucketed(events.where(matches(F.col("fields"), pattern)), params)
    return with_keys(summed(rows.withColumn("fields", prefix(F.col("fields"), len(pattern)))))


def cells_at(cells: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """The cells of a stored rollup that match a pattern; depth and the first field are filtered in the scan."""
    pattern = checked_pattern(pattern)
    keep = F.col("depth") == len(pattern)
    if pattern[0] != "*":
        keep &= F.col("f0") == pattern[0]
    return cells.where(keep & matches(F.col("fields"), pattern))

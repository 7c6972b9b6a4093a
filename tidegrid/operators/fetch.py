"""Dense series over a time range: every series of an epoch that the range touches, with zeros where nothing was tracked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.errors import InvalidTime
from tidegrid.functions.timeaxis import Range, position
from tidegrid.operators.rollup import summed
from tidegrid.params import Params

#: Points of a series in an epoch that a query may ask for.
MOST_POINTS = 10_000_000

POINT = "struct<total: double, count: double>"
SERIES = f"array<struct<fields: array<string>, points: array<{POINT}>>>"


def touched(cells: DataFrame, span: Range) -> DataFrame:
    """The cells of all epochs that a range touches, whole epochs."""
    return cells.where(F.col("epoch").between(span.first_epoch, span.last_epoch))


def sparse(cells: DataFrame, span: Range) -> DataFrame:
    """(epoch, fields, bucket, total, count) of the range's cells that were tracked, deltas added up."""
    if span.empty:
        return summed(cells).limit(0)
    return summed(touched(cells, span).where((F.col("bucket") >= span.lo) & (F.col("bucket") < span.hi)))


def series(cells: DataFrame, span: Range | None = None) -> DataFrame:
    """(epoch, fields): the series that exist in each epoch, or in those that a range touches."""
    if span is not None:
        cells = cells.limit(0) if span.empty else touched(cells, span)
    return cells.select("epoch", "fields").distinct()


def dense(cells: DataFrame, span: Range, params: Params, most_points: int = MOST_POINTS) -> DataFrame:
    """(epoch, from, to, fields, points): for every series tracked anywhere in a touched epoch its points in the range.

    cells are read once: the sums of a series' buckets within the range make a map, and the grid of buckets reads it, so a
    series that is silent within the range comes out as zeros. A series has at most duration / resolution points.
    """
    if params.points > most_points:
        raise InvalidTime(f"{params.points} points a series in an epoch; at most {most_points}")
    end = F.least(F.col("epoch") + params.duration, F.lit(span.hi).cast("long"))
    start = F.greatest(F.col("epoch"), F.lit(span.lo).cast("long"))
    rows = summed(cells.limit(0) if span.empty else touched(cells, span))
    inside = (F.col("bucket") >= span.lo) & (F.col("bucket") < span.hi)
    entry = F.when(inside, F.struct(F.col("bucket"), F.struct("total", "count").cast(POINT)))
    kept = rows.groupBy("epoch", "fields").agg(F.map_from_entries(F.collect_list(entry)).alias("at"))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("count"))
    grid = F.sequence(F.col("from"), F.col("to") - params.resolution, F.lit(params.resolution).cast("long"))
    ranged = kept.withColumns({"from": start, "to": end}).where("from < to")
    return ranged.select("epoch", "from", "to", "fields", F.transform(grid, lambda b: F.coalesce(F.try_element_at("at", b), zero)).alias("points"))


def points(cells: DataFrame, span: Range, params: Params, most_points: int = MOST_POINTS) -> DataFrame:
    """(epoch, fields, bucket, pos, total, count): dense(), a row a point."""
    rows = dense(cells, span, params, most_points).select("epoch", "fields", F.col("from"), F.posexplode("points").alias("i", "point"))
    bucket = F.col("from") + F.col("i") * params.resolution
    return rows.select("epoch", "fields", bucket.alias("bucket"), position(F.col("epoch"), bucket, params).alias("pos"), "point.total", "point.count")


def epochs(spark: SparkSession, span: Range, params: Params) -> DataFrame:
    """(epoch, from, to) of every epoch that a range touches, whether anything was tracked in it or not."""
    rows = spark.range(span.first_epoch, span.last_epoch + 1 if not span.empty else span.first_epoch, params.duration).withColumnRenamed("id", "epoch")
    return rows.select("epoch", F.greatest("epoch", F.lit(span.lo).cast("long")).alias("from"), F.least(F.col("epoch") + params.duration, F.lit(span.hi).cast("long")).alias("to"))


def chunks(cells: DataFrame, span: Range, params: Params, most_points: int = MOST_POINTS) -> DataFrame:
    """(from, to, series): one row an epoch, in order of time, its series in order of their fields.

    An epoch without matching series has an empty array. The row of an epoch holds all its series; where those may be more
    than a row should hold, points() gives the same flat.
    """
    found = dense(cells, span, params, most_points).groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("fields", "points"))).alias("series"))
    rows = epochs(cells.sparkSession, span, params).join(found, "epoch", "left")
    return rows.select("from", "to", F.coalesce("series", F.array().cast(SERIES)).alias("series")).orderBy("from")


def chunk_bounds(cells: DataFrame, span: Range, params: Params) -> DataFrame:
    """(epoch, from, to, n_series) of every chunk of a range."""
    n = series(cells, span).groupBy("epoch").agg(F.count(F.lit(1)).alias("n_series"))
    return epochs(cells.sparkSession, span, params).join(n, "epoch", "left").withColumn("n_series", F.coalesce("n_series", F.lit(0).cast("long")))


def mean(rows: DataFrame) -> DataFrame:
    """rows with the mean of a cell: total by count, null where nothing was counted."""
    return rows.withColumn("mean", F.try_divide("total", "count"))

"""The driver's tables as measurements, and the same as SQL: columns t (nanoseconds), f (path), total, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.timeaxis import Range, nanoseconds, within
from tidegrid.params import Params

HOURLY = Params.of("24h", "1h", "720h")
DAILY = Params.of("720h", "24h", "7200h")
HOUR, DAY = 3600 * 10**9, 24 * 3600 * 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, ts: str, span: Range | None, params: Params) -> DataFrame:
    """rows of the epochs that a range touches, by bounds on the stored column, so that the scan skips the others."""
    return rows if span is None else rows.where(within(F.col(ts), span, params))


def shaped(rows: DataFrame, ts: Column, fields: list[Column], total: Column, count: Column | None = None) -> DataFrame:
    path = F.array(*[x.cast("string") for x in fields])
    return rows.select(nanoseconds(ts).alias("ts_ns"), path.alias("fields"), total.cast("double").alias("total"), (F.lit(1.0) if count is None else count.cast("double")).alias("count"))


def e1(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Events by type and a fifth of the users."""
    return shaped(bounded(table(spark, sf_dir, "events"), "ts", span, HOURLY), F.col("ts"), [F.col("event_type"), F.col("user_id") % 5], F.col("value"))


def e2(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Events by type, a fifth of the users and user."""
    return shaped(bounded(table(spark, sf_dir, "events"), "ts", span, HOURLY), F.col("ts"), [F.col("event_type"), F.col("user_id") % 5, F.col("user_id")], F.col("value"))


def e3(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Events by paths of one to three of those fields."""
    rows = bounded(table(spark, sf_dir, "events"), "ts", span, HOURLY)
    whole = shaped(rows.withColumn("depth", (F.col("event_id") % 3 + 1).cast("int")), F.col("ts"), [F.col("event_type"), F.col("user_id") % 5, F.col("user_id"), F.col("depth")], F.col("value"))
    return whole.withColumn("fields", F.slice("fields", F.lit(1), F.get("fields", F.lit(3)).cast("int")))


def e4(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Orders by priority and status."""
    return shaped(bounded(table(spark, sf_dir, "orders"), "o_orderdate", span, DAILY), F.col("o_orderdate"), [F.col("o_orderpriority"), F.col("o_orderstatus")], F.col("o_totalprice"))


def e5(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Line items by return flag and status."""
    return shaped(bounded(table(spark, sf_dir, "lineitem"), "l_shipdate", span, DAILY), F.col("l_shipdate"), [F.col("l_returnflag"), F.col("l_linestatus")], F.col("l_extendedprice"))


def e6(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Line items summed up by order, time and flags, with the number of lines as count."""
    rows = bounded(table(spark, sf_dir, "lineitem"), "l_shipdate", span, DAILY).groupBy("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))
    return shaped(rows, F.col("l_shipdate"), [F.col("l_returnflag"), F.col("l_linestatus")], F.col("price"), F.col("n"))


def e7(spark: SparkSession, sf_dir: str, span: Range | None = None) -> DataFrame:
    """Line items by the supplier's region, nation and name."""
    rows = bounded(table(spark, sf_dir, "lineitem"), "l_shipdate", span, DAILY).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return shaped(rows, F.col("l_shipdate"), [F.col("r_name"), F.col("n_name"), F.col("s_name")], F.col("l_quantity"))


_FIVE = "event_type, cast(user_id % 5 as varchar)"
SQL = {
    e1: f"select epoch_us(ts) * 1000 as t, [{_FIVE}] as f, value as total, 1.0::double as count from events",
    e2: f"select epoch_us(ts) * 1000 as t, [{_FIVE}, cast(user_id as varchar)] as f, value as total, 1.0::double as count from events",
    e3: f"select epoch_us(ts) * 1000 as t, list_slice([{_FIVE}, cast(user_id as varchar)], 1, event_id % 3 + 1) as f, value as total, 1.0::double as count from events",
    e4: "select epoch_us(o_orderdate) * 1000 as t, [o_orderpriority, o_orderstatus] as f, o_totalprice as total, 1.0::double as count from orders",
    e5: "select epoch_us(l_shipdate) * 1000 as t, [l_returnflag, l_linestatus] as f, l_extendedprice as total, 1.0::double as count from lineitem",
    e6: "select epoch_us(l_shipdate) * 1000 as t, [l_returnflag, l_linestatus] as f, sum(l_extendedprice) as total, cast(count(*) as double) as count from lineitem group by l_orderkey, l_shipdate, l_returnflag, l_linestatus",
    e7: "select epoch_us(l_shipdate) * 1000 as t, [r_name, n_name, s_name] as f, l_quantity as total, 1.0::double as count from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
}

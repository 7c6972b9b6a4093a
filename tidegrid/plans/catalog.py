"""Named queries over the driver's tables, and the SQL that gives the same rows.

Every query returns flat rows of scalars: path is the fields joined by "/", times are nanoseconds since 1970-01-01.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.errors import InvalidParams, InvalidTime, ReadOnly
from tidegrid.functions.paths import checked_pattern
from tidegrid.functions.timeaxis import nanoseconds, ns_range, position
from tidegrid.operators import fetch, rollup
from tidegrid.params import Params, parse_duration
from tidegrid.plans import adapters as A
from tidegrid.plans.adapters import DAILY, DAY, HOUR, HOURLY, SQL
from tidegrid.plans.route import cells_of
from tidegrid.sources.files import scratch
from tidegrid.sources.store import MetricStore, load_all
from tidegrid.streaming.track import track_stream, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-01 and 1996-01-01, where the ranges of the queries begin.
JAN, Y96 = 1_704_067_200 * 10**9, 820_454_400 * 10**9


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def path(column: str = "fields"):
    return F.array_join(column, "/").alias("path")


def measures():
    return [F.round("total", 4).alias("total"), F.col("count")]


# what the SQL of many queries shares


def cells_sql(of: str, p: Params, depth: int | None = None, where: str = "true") -> str:
    """Cells (epoch, bucket, f, total, count): of every prefix, or of those of one depth."""
    ups = "unnest(list_transform(generate_series(1, len(f)), lambda k: list_slice(f, 1, k)))" if depth is None else f"list_slice(f, 1, {depth})"
    least = 1 if depth is None else depth
    return f"""select epoch, bucket, f, sum(total) as total, sum(count) as count from (
        select t // {p.duration} * {p.duration} as epoch, t // {p.resolution} * {p.resolution} as bucket, {ups} as f, total, count
        from ({of}) where len(f) >= {least} and {where}) group by all"""


def pattern_sql(pattern: list[str]) -> str:
    return " and ".join(["true", *(f"f[{i + 1}] = '{v}'" for i, v in enumerate(pattern) if v != "*")])


def fetch_sql(of: str, p: Params, start: int, end: int, pattern: list[str]) -> str:
    """The dense points of a pattern's series: of those in whole epochs, on the grid of the range."""
    r = ns_range(start, end, p)
    return f"""with c as ({cells_sql(of, p, len(pattern), pattern_sql(pattern))}),
        s as (select distinct epoch, f from c where epoch between {r.first_epoch} and {r.last_epoch}),
        g as (select epoch, f, unnest(generate_series(greatest(epoch, {r.lo}), least(epoch + {p.duration}, {r.hi}) - {p.resolution}, {p.resolution})) as bucket from s)
        select array_to_string(g.f, '/') as path, g.epoch, g.bucket, cast((g.bucket - g.epoch) // {p.resolution} as integer) as pos,
            round(coalesce(c.total, 0), 4) as total, coalesce(c.count, 0.0) as count
        from g left join c on g.epoch = c.epoch and g.f = c.f and g.bucket = c.bucket"""


def flat(points: DataFrame) -> DataFrame:
    return points.select(path(), "epoch", "bucket", "pos", *measures())


def add_fetch(name: str, adapter: Query, p: Params, start: int, end: int, pattern: list[str]) -> None:
    """Straight from events: pattern and epochs below the aggregate, sums of one level only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        span = ns_range(start, end, p)
        return flat(fetch.points(rollup.rollup_at(adapter(spark, sf_dir, span), p, pattern, span), span, p))

    add(name, run, fetch_sql(SQL[adapter], p, start, end, pattern))


def listed(cells: DataFrame) -> DataFrame:
    return cells.select(path(), "epoch", "bucket", *measures())


LISTED = "select array_to_string(f, '/') as path, epoch, bucket, round(total, 4) as total, count from ({})"


def add_rollup(name: str, adapter: Query, p: Params, pattern: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = adapter(spark, sf_dir)
        return listed(rollup.rollup(events, p) if pattern is None else rollup.rollup_at(events, p, pattern))

    add(name, run, LISTED.format(cells_sql(SQL[adapter], p, pattern and len(pattern), pattern_sql(pattern or []))))


# the time axis


def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch, bucket and position of every event."""
    rows = A.table(spark, sf_dir, "events").select("event_id", nanoseconds(F.col("ts")).alias("ts_ns"))
    rows = rollup.bucketed(rows, HOURLY)
    return rows.select("event_id", "epoch", "bucket", position(F.col("epoch"), F.col("bucket"), HOURLY).alias("pos"))


add("bucketize", bucketize, f"""select event_id, t // {DAY} * {DAY} as epoch, t // {HOUR} * {HOUR} as bucket, cast(t % {DAY} // {HOUR} as integer) as pos
    from (select event_id, epoch_us(ts) * 1000 as t from events)""")


def epoch_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every epoch in a range, also of those without."""
    span = ns_range(JAN - DAY, JAN + 32 * DAY, HOURLY)
    n = rollup.bucketed(A.e1(spark, sf_dir), HOURLY).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
    return fetch.epochs(spark, span, HOURLY).join(n, "epoch", "left").select("epoch", F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))


add("epoch_partitions", epoch_partitions, f"""with n as (select t // {DAY} * {DAY} as epoch, count(*) as n from ({SQL[A.e1]}) group by all)
    select e.epoch, coalesce(n.n, 0) as n_events from (select unnest(generate_series({JAN - DAY}, {JAN + 31 * DAY}, {DAY})) as epoch) e left join n using (epoch)""")

# rollups

add_rollup("prefix_rollup_all", A.e2, HOURLY)
add_rollup("rollup_depth1", A.e2, HOURLY, ["*"])
add_rollup("rollup_depth2", A.e2, HOURLY, ["*", "*"])
add_rollup("rollup_depth3", A.e2, HOURLY, ["*", "*", "*"])
add_rollup("ragged_depth", A.e3, HOURLY)
add_rollup("preaggregated_count", A.e6, DAILY)
add_rollup("orders_rollup", A.e4, DAILY)
add_rollup("region_rollup", A.e7, DAILY)


def explode_form_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the rollup of all levels."""
    return listed(rollup.cells_at(rollup.rollup(A.e2(spark, sf_dir), HOURLY), ["*", "*"]))


def slice_form_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same level alone, from one row an event."""
    return listed(rollup.rollup_at(A.e2(spark, sf_dir), HOURLY, ["*", "*"]))


add("explode_form_rollup", explode_form_rollup, ORACLE_SQL["rollup_depth2"])
add("slice_form_rollup", slice_form_rollup, ORACLE_SQL["rollup_depth2"])


def mean_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fetch.mean(rollup.rollup_at(A.e1(spark, sf_dir), HOURLY, ["*"]))
    return rows.select(path(), "bucket", F.round("mean", 4).alias("mean"))


add("mean_per_bucket", mean_per_bucket, f"select array_to_string(f, '/') as path, bucket, round(total / count, 4) as mean from ({cells_sql(SQL[A.e1], HOURLY, 1)})")

# fetches

D2 = JAN + DAY
add_fetch("fetch_exact", A.e1, HOURLY, D2, D2 + 3 * DAY, ["click", "3"])
add_fetch("fetch_wild_last", A.e1, HOURLY, D2, D2 + 3 * DAY, ["click", "*"])
add_fetch("fetch_wild_mid", A.e2, HOURLY, D2, D2 + 10 * DAY, ["click", "*", "13"])
add_fetch("fetch_wild_first", A.e1, HOURLY, D2, D2 + 3 * DAY, ["*", "3"])
add_fetch("fetch_wild_all", A.e1, HOURLY, D2, D2 + 2 * DAY, ["*", "*"])
add_fetch("fetch_unknown", A.e1, HOURLY, D2, D2 + 3 * DAY, ["click", "zzz"])
add_fetch("fetch_dense_zero_fill", A.e2, HOURLY, D2 + 20 * HOUR, D2 + 51 * HOUR, ["click", "*", "*"])
add_fetch("fetch_multi_epoch", A.e1, HOURLY, D2 + 7 * HOUR, D2 + 3 * DAY + 5 * HOUR, ["*", "*"])
add_fetch("fetch_unaligned_range", A.e1, HOURLY, D2 + 7 * HOUR + 12345, D2 + 2 * DAY + 59 * 60 * 10**9, ["view", "*"])
add_fetch("fetch_one_bucket", A.e1, HOURLY, D2 + 5 * HOUR, D2 + 6 * HOUR, ["*", "1"])
add_fetch("fetch_lineitem", A.e5, DAILY, Y96 + 10 * DAY, Y96 + 100 * DAY, ["*", "F"])
add_fetch("fetch_region", A.e7, DAILY, Y96, Y96 + 45 * DAY, ["ASIA", "*"])
add_fetch("fetch_orders_month", A.e4, DAILY, Y96, Y96 + 365 * DAY, ["*", "*"])

add_fetch("fetch_unknown_first", A.e1, HOURLY, D2, D2 + 3 * DAY, ["zzz"])
add_fetch("fetch_leading_wild_users", A.e2, HOURLY, D2, D2 + 2 * DAY, ["*", "3", "*"])
add_fetch("fetch_leading_wild_nation", A.e7, DAILY, Y96, Y96 + 45 * DAY, ["*", "NATION_9"])
add_fetch("fetch_ragged", A.e3, HOURLY, D2, D2 + 2 * DAY, ["*", "*"])

SPAN = (JAN - 2 * DAY, D2 + 2 * DAY + 3 * HOUR)


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and number of series of every chunk, also of empty ones."""
    span = ns_range(*SPAN, HOURLY)
    cells = rollup.rollup_at(A.e2(spark, sf_dir, span), HOURLY, ["click", "*", "*"], span)
    return fetch.chunk_bounds(cells, span, HOURLY).select("epoch", F.col("from").alias("from_ns"), F.col("to").alias("to_ns"), "n_series")


def bounds_sql() -> str:
    r = ns_range(*SPAN, HOURLY)
    return f"""with n as (select epoch, count(distinct f) as n from ({cells_sql(SQL[A.e2], HOURLY, 3, pattern_sql(["click", "*", "*"]))}) group by all)
        select e.epoch, greatest(e.epoch, {r.lo}) as from_ns, least(e.epoch + {DAY}, {r.hi}) as to_ns, coalesce(n.n, 0) as n_series
        from (select unnest(generate_series({r.first_epoch}, {r.last_epoch}, {DAY})) as epoch) e left join n using (epoch)"""


add("chunk_bounds", chunk_bounds, bounds_sql())


def chunks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested chunks, taken apart again."""
    span = ns_range(D2 + 7 * HOUR, D2 + 3 * DAY, HOURLY)
    return unnested(fetch.chunks(rollup.rollup_at(A.e1(spark, sf_dir, span), HOURLY, ["*", "3"], span), span, HOURLY))


def unnested(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("from", "to", F.explode("series").alias("s")).select("from", "to", "s.fields", F.posexplode("s.points").alias("i", "point"))
    return rows.select(F.col("from").alias("from_ns"), F.col("to").alias("to_ns"), path(), "i", F.round("point.total", 4).alias("total"), "point.count")


add("chunks_flat", chunks_flat, f"""select greatest(epoch, {D2 + 7 * HOUR}) as from_ns, least(epoch + {DAY}, {D2 + 3 * DAY}) as to_ns, path,
    cast((bucket - greatest(epoch, {D2 + 7 * HOUR})) // {HOUR} as integer) as i, total, count from ({fetch_sql(SQL[A.e1], HOURLY, D2 + 7 * HOUR, D2 + 3 * DAY, ["*", "3"])})""")


def series_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of every epoch, of all depths."""
    return fetch.series(rollup.rollup(A.e3(spark, sf_dir), HOURLY)).select("epoch", path())


add("series_listing", series_listing, f"select distinct epoch, array_to_string(f, '/') as path from ({cells_sql(SQL[A.e3], HOURLY)})")

# values and ranges at the edges


def zero_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that only zeros were tracked in are there all the same."""
    span = ns_range(D2, D2 + 2 * DAY, HOURLY)
    rows = A.e1(spark, sf_dir, span).withColumns({"total": F.col("total") * 0, "count": F.col("count") * 0})
    return flat(fetch.points(rollup.rollup_at(rows, HOURLY, ["error", "*"], span), span, HOURLY))


add("zero_series", zero_series, fetch_sql(f"select t, f, total * 0 as total, count * 0 as count from ({SQL[A.e1]})", HOURLY, D2, D2 + 2 * DAY, ["error", "*"]))


def nan_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum with a measure that is no number is none either; the count stays."""
    rows = A.e1(spark, sf_dir).withColumn("total", F.when(F.col("total") < 5, F.lit(float("nan"))).otherwise(F.col("total")))
    cells = rollup.rollup_at(rollup.measurements(rows), HOURLY, ["*"])
    return cells.select(path(), "bucket", F.isnan("total").alias("none"), F.col("count"))


add("nan_sums", nan_sums, f"select array_to_string(f, '/') as path, bucket, total > 0 as none, count from ({cells_sql(f'select t, f, cast(total < 5 as integer) as total, count from ({SQL[A.e1]})', HOURLY, 1)})")

RANGES = [(5, 1), (-1, HOUR), (0, 0), (0, HOUR - 1), (HOUR, HOUR), (HOUR + 1, HOUR + 2), (0, HOUR), (DAY - 1, DAY + HOUR), (HOUR, 1 << 62), (3 * HOUR + 7, 2 * DAY + 9)]


def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ranges are errors, and the buckets and epochs of the others; -1 where there are none."""
    out = []
    for start, end in RANGES:
        try:
            r = ns_range(start, end, HOURLY)
            out.append((start, end, "empty" if r.empty else "range", r.lo, r.hi, r.first_epoch, -1 if r.empty else r.last_epoch))
        except InvalidTime:
            out.append((start, end, "error", -1, -1, -1, -1))
    return spark.createDataFrame(out, "start_ns long, end_ns long, kind string, lo long, hi long, first_epoch long, last_epoch long")


add("range_rules", range_rules, f"""with r as (select * from (values {", ".join(f"({a}::bigint, {b}::bigint)" for a, b in RANGES)}) x(s, e)),
    k as (select s, e, s < 0 or e < s or e < {HOUR} as bad, s // {HOUR} * {HOUR} as lo, e // {HOUR} * {HOUR} as hi from r)
    select s as start_ns, e as end_ns, case when bad then 'error' when lo >= hi then 'empty' else 'range' end as kind, case when not bad then lo else -1 end as lo, case when not bad then hi else -1 end as hi,
        case when not bad then lo // {DAY} * {DAY} else -1 end as first_epoch, case when not bad and lo < hi then (hi - 1) // {DAY} * {DAY} else -1 end as last_epoch from k""")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each kind an ingest leaves out."""
    rows = A.e1(spark, sf_dir).withColumns({
        "fields": F.when(F.col("total") < 10, F.array_append("fields", F.lit("*"))).otherwise(F.col("fields")),
        "ts_ns": F.when(F.col("total") > 90, -F.col("ts_ns")).otherwise(F.col("ts_ns")),
    })
    return rollup.rejected(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


add("rejected_rows", rejected_rows, f"select case when total > 90 then 'invalid timestamp' else 'invalid fields' end as reason, count(*) as n from ({SQL[A.e1]}) where total > 90 or total < 10 group by 1")

DURATIONS = [("1h", 3_600 * 10**9), ("1h30m", 5_400 * 10**9), ("90s", 90 * 10**9), ("1.5s", 1_500_000_000), ("-2ms", -2_000_000), ("0", 0), ("5", -1), ("", -1), ("1x", -1), ("1 h", -1)]


def duration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What duration strings mean in nanoseconds; -1 for those that are none."""

    def meant(text: str) -> int:
        try:
            return parse_duration(text)
        except InvalidParams:
            return -1

    return spark.createDataFrame([(t, meant(t)) for t, _ in DURATIONS], "text string, ns long")


add("duration_rules", duration_rules, f"select * from (values {', '.join(f"('{t}', {n}::bigint)" for t, n in DURATIONS)}) x(text, ns)")

# duration, resolution, retention, limits on open epochs
PARAMS = [("1h", "1m", "24h", 10, 3, True), ("1h", "31m", "24h", 10, 3, False), ("1h", "1m", "90m", 10, 3, False), ("1h", "1m", "24h", 10, 0, False), ("1h", "1h", "1h", 1, 1, True), ("0", "1m", "24h", 1, 1, False), ("1h", "2h", "24h", 1, 1, False), ("-1h", "1m", "24h", 1, 1, False)]


def params_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters a store may have."""

    def valid(*given) -> bool:
        try:
            return Params.from_json(Params.of(*given).to_json()) == Params.of(*given)
        except InvalidParams:
            return False

    return spark.createDataFrame([(i, valid(*given)) for i, (*given, _) in enumerate(PARAMS)], "n int, valid boolean")


add("params_rules", params_rules, f"select * from (values {', '.join(f'({i}::int, {str(ok).lower()})' for i, (*_, ok) in enumerate(PARAMS))}) x(n, valid)")


def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every series in its chunk: by their fields, level by level."""
    span = ns_range(D2, D2 + DAY, HOURLY)
    rows = fetch.chunks(rollup.rollup_at(A.e2(spark, sf_dir, span), HOURLY, ["*", "*", "*"], span), span, HOURLY)
    return rows.select(F.col("from").alias("from_ns"), F.posexplode("series").alias("place", "s")).select("from_ns", "place", path("s.fields"))


add("series_order", series_order, f"""select epoch as from_ns, cast(row_number() over (partition by epoch order by f[1], f[2], f[3]) - 1 as integer) as place, array_to_string(f, '/') as path
    from (select distinct epoch, f from ({cells_sql(SQL[A.e2], HOURLY, 3)}) where epoch = {D2})""")

# stores


def store_of(spark: SparkSession, name: str, *events: DataFrame, params: Params = HOURLY) -> MetricStore:
    """A new store in the scratch folder, with each of the tables tracked as a batch."""
    out = MetricStore.open(spark, scratch(spark, name), params)
    for e in events:
        out.track(e)
    return out


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = A.e1(spark, sf_dir)
    even = F.xxhash64("ts_ns", "fields", "total") % 2 == 0
    return rows.where(even), rows.where(~even)


def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves tracked one after the other, added up when fetched."""
    store = store_of(spark, "delta", *halves(spark, sf_dir))
    return flat(store.fetch(D2, D2 + 3 * DAY, ["click", "*"]))


add("delta_merge", delta_merge, ORACLE_SQL["fetch_wild_last"])


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the deltas have been made one."""
    store = store_of(spark, "compacted", *halves(spark, sf_dir))
    store.compact()
    return flat(store.fetch(D2, D2 + 3 * DAY, ["*", "3"]))


add("compacted", compacted, ORACLE_SQL["fetch_wild_first"])


def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested chunks of a store, opened for reading only."""
    store = store_of(spark, "chunked", *halves(spark, sf_dir))
    store.compact()
    return unnested(MetricStore(spark, store.path, store.params, read_only=True).fetch_chunks(D2 + 7 * HOUR, D2 + 3 * DAY, ["*", "3"]))


add("store_chunks", store_chunks, ORACLE_SQL["chunks_flat"])


def read_only_refuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which actions a store that is open for reading only refuses, and how many points it reads after a later write."""
    store = store_of(spark, "refuses")
    reader = MetricStore(spark, store.path, store.params, read_only=True)
    store.track(A.e1(spark, sf_dir, ns_range(D2, D2 + DAY, HOURLY)))

    def refused(action: Callable) -> int:
        try:
            action()
            return 0
        except ReadOnly:
            return 1

    rows = [("track", refused(lambda: reader.track(A.e1(spark, sf_dir)))), ("expire", refused(lambda: reader.expire(JAN))), ("compact", refused(reader.compact)), ("vacuum", refused(reader.vacuum))]
    read = reader.fetch(D2, D2 + DAY, ["click"]).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("points").alias("action"), "n")
    return spark.createDataFrame(rows, "action string, n int").union(read)


add("read_only_refuses", read_only_refuses, "select * from (values ('track', 1), ('expire', 1), ('compact', 1), ('vacuum', 1), ('points', 24)) x(action, n)")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question put to a store where there is one with the parameters, else to the events: both answers side by side."""
    p, pattern, (start, end) = HOURLY, ["click", "*"], (D2, D2 + 2 * DAY)
    span = ns_range(start, end, p)
    out = None
    for name, stores in (("events", []), ("store", [store_of(spark, "routed", A.e1(spark, sf_dir)), store_of(spark, "other", params=DAILY)])):
        rows = flat(fetch.points(cells_of(A.e1(spark, sf_dir, span), p, pattern, span, stores), span, p)).withColumn("source", F.lit(name))
        out = rows if out is None else out.union(rows)
    return out


add("routed", routed, " union all ".join(f"select *, '{name}' as source from ({fetch_sql(SQL[A.e1], HOURLY, D2, D2 + 2 * DAY, ['click', '*'])})" for name in ("events", "store")))


def expire_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a store after all epochs that start before a time within one have gone."""
    store = store_of(spark, "expire", A.e1(spark, sf_dir))
    store.expire(JAN + 20 * DAY + HOUR)
    return listed(rollup.cells_at(store.cells(), ["*"]))


add("expire_before", expire_before, LISTED.format(f"select * from ({cells_sql(SQL[A.e1], HOURLY, 1)}) where epoch >= {JAN + 20 * DAY + HOUR}"))


def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs that start within the retention."""
    p = Params.of("24h", "1h", "168h")
    store = store_of(spark, "retention", A.e1(spark, sf_dir), params=p)
    return flat(store.fetch(JAN, JAN + 30 * DAY, ["purchase"], now=JAN + 30 * DAY))


add("retention_filter", retention_filter, f"select * from ({fetch_sql(SQL[A.e1], HOURLY, JAN, JAN + 30 * DAY, ['purchase'])}) where epoch >= {JAN + 23 * DAY}")


def loaded_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores found again by their folder, side by side."""
    root = scratch(spark, "root")
    for name, e in (("events", A.e1(spark, sf_dir)), ("users", A.e2(spark, sf_dir))):
        MetricStore.open(spark, f"{root}/{name}", HOURLY).track(e)
    out = None
    for name, store in sorted(load_all(spark, root).items()):
        rows = flat(store.fetch(D2, D2 + DAY, ["error"])).withColumn("store", F.lit(name))
        out = rows if out is None else out.union(rows)
    return out


add("loaded_stores", loaded_stores, " union all ".join(f"select *, '{name}' as store from ({fetch_sql(SQL[a], HOURLY, D2, D2 + DAY, ['error'])})" for name, a in (("events", A.e1), ("users", A.e2))))


# streams


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = A.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return A.shaped(rows, F.col("ts"), [F.col("event_type"), F.col("user_id") % 5], F.col("value"))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events tracked by a stream, fetched from the store."""
    store = store_of(spark, "streamed")
    track_stream(streamed(spark, sf_dir), store, scratch(spark, "checkpoint"), "rollup", once=True).awaitTermination()
    return listed(rollup.summed(store.cells().where("depth = 2")))


add("stream_rollup", stream_rollup, LISTED.format(cells_sql(SQL[A.e1], HOURLY, 2)))


def stream_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one store, whose last micro-batches come again after a compaction: all count once."""
    store = store_of(spark, "replayed")
    rows = streamed(spark, sf_dir)
    even = F.xxhash64("ts_ns", "fields", "total") % 2 == 0
    for half in (rows.where(even), rows.where(~even)):
        track_stream(half, store, scratch(spark, "checkpoint"), once=True).awaitTermination()
    first = store.cells().select("batch").distinct().collect()
    store.compact()
    for name, half in zip(sorted({r.batch for r in first}), halves(spark, sf_dir), strict=True):
        store.write_batch(rollup.measurements(half), name)
    return listed(rollup.summed(store.cells().where("depth = 2")))


add("stream_replayed", stream_replayed, ORACLE_SQL["stream_rollup"])


#: Micro-batches that events out of order come in, however many they are.
SLICES = 8


def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come newest first, in several micro-batches, tracked by a stream without watermark.

    The events are written once, in slices of about as many by their time; a slice comes in by one renaming when the stream
    has tracked those before, so micro-batches grow with the table, not their number.
    """
    rows, at = A.table(spark, sf_dir, "events"), nanoseconds(F.col("ts"))
    bounds = rows.select(at.alias("t")).approxQuantile("t", [k / SLICES for k in range(1, SLICES)], 0.01)
    later = [F.coalesce((at <= int(b)).cast("int"), F.lit(1)) for b in bounds]
    sliced = rows.withColumn("slice", sum(later, F.lit(0))).sortWithinPartitions("slice", F.desc("ts"))
    waiting, source = scratch(spark, "newest_first"), scratch(spark, "come_in")
    sliced.write.partitionBy("slice").parquet(waiting)
    store = store_of(spark, "out_of_order")
    store.files.folder(source)
    come = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source)
    track_stream(A.shaped(come, F.col("ts"), [F.col("event_type"), F.col("user_id") % 5], F.col("value")), store, scratch(spark, "checkpoint"))
    try:
        for name in store.files.folders(waiting):  # slice=0, the newest, is the first of less than ten
            store.files.rename(f"{waiting}/{name}", f"{source}/{name}")
            store.sync()
    finally:
        store.close()
    return listed(rollup.summed(store.cells().where("depth = 2")))


add("stream_out_of_order", stream_out_of_order, ORACLE_SQL["stream_rollup"])


def stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a streaming aggregate that are over a day older than the newest event, each written once."""
    rows = streamed(spark, sf_dir).withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")))
    to = scratch(spark, "closed")
    query = windowed(rows, HOURLY, late="1 day").writeStream.outputMode("append").format("parquet").option("path", to).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(to).select(path(), "bucket", *measures())


add("stream_watermark", stream_watermark, f"""select array_to_string(f, '/') as path, bucket, round(total, 4) as total, count from ({cells_sql(SQL[A.e1], HOURLY)})
    where bucket + {HOUR} <= (select max(t) // 1000000 * 1000000 - {DAY} from ({SQL[A.e1]}))""")


def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rolled up by a streaming aggregate whose state is written out whole."""
    rows = streamed(spark, sf_dir).withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")))
    to = scratch(spark, "windowed")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(to)

    query = windowed(rows, HOURLY).writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "checkpoint")).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(to).select(path(), "bucket", *measures())


add("stream_windowed", stream_windowed, f"select array_to_string(f, '/') as path, bucket, round(total, 4) as total, count from ({cells_sql(SQL[A.e1], HOURLY)})")


def measured_strictly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest with invalid rows left out: paths with an empty or wildcard element, and null measures."""
    rows = A.e3(spark, sf_dir).withColumn("fields", F.when(F.col("total") < 10, F.array_append("fields", F.lit(""))).otherwise(F.col("fields")))
    return listed(rollup.rollup(rollup.measurements(rows, drop_invalid=True), HOURLY).where(F.size("fields") == len(checked_pattern(["*"]))))


add("measured_strictly", measured_strictly, LISTED.format(cells_sql(f"select * from ({SQL[A.e3]}) where total >= 10", HOURLY, 1)))

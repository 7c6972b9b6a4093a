"""Examples of rollups and fetches whose results follow from the definitions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.errors import InvalidFields, InvalidTime
from tidegrid.functions.timeaxis import ns_range
from tidegrid.operators import fetch, rollup
from tidegrid.params import Params

P0 = Params.of("1h", "1m", "10h", 2, 2)
R, D = P0.resolution, P0.duration
SCHEMA = "ts_ns long, fields array<string>, total double, count double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def chunks(spark, rows, start, end, pattern, params=P0):
    """[(from, to, {path: points})], the same from events and from the whole rollup."""
    events = table(spark, rows)
    span = ns_range(start, end, params)
    out = []
    for cells in (rollup.rollup_at(events, params, pattern), rollup.cells_at(rollup.rollup(events, params), pattern)):
        found = fetch.chunks(cells, span, params).collect()
        out.append([(r["from"], r["to"], {"/".join(s.fields): [(p.total, p["count"]) for p in s.points] for s in r.series}) for r in found])
    assert out[0] == out[1]
    return out[0]


def test_two_points(spark):
    rows = [(0, ["a", "b", "d"], 5.0, 1.0), (R, ["a", "b", "d"], 5.0, 2.0)]
    assert chunks(spark, rows, 0, 2 * R, ["a", "b", "d"]) == [(0, 2 * R, {"a/b/d": [(5, 1), (5, 2)]})]


def test_wildcard_with_zeros(spark):
    rows = [(0, ["a", "b", "c"], 5.0, 1.0), (R, ["a", "b", "d"], 5.0, 2.0)]
    assert chunks(spark, rows, 0, 2 * R, ["a", "b", "*"]) == [(0, 2 * R, {"a/b/c": [(5, 1), (0, 0)], "a/b/d": [(0, 0), (5, 2)]})]


def test_two_epochs(spark):
    rows = [(D - R, ["a", "b", "d"], 5.0, 1.0), (D, ["a", "b", "d"], 5.0, 2.0)]
    assert chunks(spark, rows, D - R, D + R, ["a", "b", "d"]) == [(D - R, D, {"a/b/d": [(5, 1)]}), (D, D + R, {"a/b/d": [(5, 2)]})]


def test_rollup_of_prefixes(spark):
    rows = [(i * R, f, v, v) for i in range(5) for f, v in ((["a", "b", "c"], 1.0), (["a", "b", "d"], 2.0), (["a", "c", "e"], 3.0))]
    for path, v in (("a", 6), ("a b", 3), ("a b c", 1), ("a b d", 2), ("a c", 3), ("a c e", 3)):
        assert chunks(spark, rows, 0, 5 * R, path.split()) == [(0, 5 * R, {path.replace(" ", "/"): [(v, v)] * 5})]


@pytest.mark.parametrize(
    ("pattern", "found"),
    [("a b *", {"a/b/c", "a/b/d"}), ("a * c", {"a/b/c", "a/e/c"}), ("a * *", {"a/b/c", "a/b/d", "a/e/c"}), ("a b z", set()), ("z * c", set()), ("* b", {"a/b"}), ("*", {"a"}), ("a b c d", set()), ("a *b", set())],
)
def test_patterns(spark, pattern, found):
    rows = [(0, x.split(), 1.0, 1.0) for x in ("a b c", "a b d", "a e c")]
    assert {p for _, _, s in chunks(spark, rows, 0, R, pattern.split()) for p in s} == found


def test_silent_series_and_empty_epoch(spark):
    rows = [(0, ["a"], 1.0, 1.0), (2 * D + 5, ["b"], 1.0, 1.0)]
    assert chunks(spark, rows, 3 * R, 5 * R, ["*"]) == [(3 * R, 5 * R, {"a": [(0, 0)] * 2})]
    found = chunks(spark, rows, D - 2 * R, 2 * D + R, ["*"])
    assert [(a, b, set(s)) for a, b, s in found] == [(D - 2 * R, D, {"a"}), (D, 2 * D, set()), (2 * D, 2 * D + R, {"b"})]


def test_leaf_and_ancestor_and_sums(spark):
    assert chunks(spark, [(0, ["a"], 1.0, 1.0), (0, ["a", "b"], 2.0, 2.0)], 0, R, ["a"]) == [(0, R, {"a": [(3, 3)]})]
    assert chunks(spark, [(0, ["a"], -1.5, 0.5), (0, ["a"], -1.5, 0.5)], 0, R, ["a"]) == [(0, R, {"a": [(-3, 1)]})]
    assert chunks(spark, [(0, ["a"], 0.0, 0.0)], 0, R, ["a"]) == [(0, R, {"a": [(0, 0)]})]


def test_no_fields_no_rows(spark):
    rows = table(spark, [(0, [], 1.0, 1.0), (0, None, 1.0, 1.0), (0, ["a"], 1.0, 1.0)])
    assert rollup.rollup(rollup.measurements(rows), P0).count() == 1
    assert rollup.rollup(rows, P0).count() == 1


@pytest.mark.parametrize("bad", [(0, ["a", ""], 1.0, 1.0), (0, ["*"], 1.0, 1.0), (0, [None], 1.0, 1.0), (-1, ["a"], 1.0, 1.0), (None, ["a"], 1.0, 1.0), (0, ["a"], None, 1.0)])
def test_invalid_measurements(spark, bad):
    rows = table(spark, [bad, (0, ["a"], 1.0, 1.0)])
    assert rollup.measurements(rows, drop_invalid=True).count() == 1
    with pytest.raises(Exception, match="invalid|null"):
        rollup.measurements(rows).collect()


def test_empty_ranges_and_tables(spark):
    rows = [(0, ["a"], 1.0, 1.0)]
    assert chunks(spark, rows, R + 1, R + 2, ["a"]) == []
    assert chunks(spark, [], 0, R, ["a"]) == [(0, R, {})]
    events = table(spark, rows)
    cells = rollup.rollup_at(events, P0, ["a"])
    for f in (fetch.sparse(cells, ns_range(D, D, P0)), fetch.series(cells, ns_range(D, D, P0)), fetch.points(cells, ns_range(D, D, P0), P0)):
        assert f.count() == 0
    with pytest.raises(InvalidFields):
        rollup.rollup_at(events, P0, [])
    with pytest.raises(InvalidTime):
        fetch.dense(cells, ns_range(0, D, P0), P0, most_points=10)


def test_scan_filters(spark, tmp_path):
    rollup.rollup(table(spark, [(i * R, ["a", str(i % 3)], 1.0, 1.0) for i in range(200)]), P0).write.partitionBy("epoch").parquet(f"{tmp_path}/cells")
    rows = fetch.touched(rollup.cells_at(spark.read.parquet(f"{tmp_path}/cells"), ["a", "*"]), ns_range(D, 2 * D, P0))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(depth,2)" in plan and "EqualTo(f0,a)" in plan and "PartitionFilters: [isnotnull(epoch" in plan


events = st.lists(st.tuples(st.integers(0, 3 * D), st.lists(st.sampled_from("abc"), max_size=3), st.integers(-9, 9).map(float), st.integers(0, 3).map(float)), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events, st.lists(st.sampled_from("ab*"), min_size=1, max_size=3), st.integers(1, 3 * D // R), st.integers(1, 3 * D // R), st.integers(1, 3 * D // R))
def test_properties(spark, rows, pattern, a, b, c):
    a, b, c = sorted((a * R, b * R, c * R))
    cells = rollup.rollup_at(table(spark, rows), P0, pattern)
    flat = lambda x, y: sorted(map(str, fetch.sparse(cells, ns_range(x, y, P0)).collect()))
    assert sorted(flat(a, b) + flat(b, c)) == flat(a, c)
    whole = chunks(spark, rows, a, c, pattern)
    want = {}
    for ts, f, total, count in rows:
        if len(f) >= len(pattern) and all(p in ("*", x) for p, x in zip(pattern, f, strict=False)):
            cell = want.setdefault(("/".join(f[: len(pattern)]), ts // R * R), [0.0, 0.0])
            cell[0] += total
            cell[1] += count
    got = {(p, at + i * R): list(v) for at, _, s in whole for p, points in s.items() for i, v in enumerate(points)}
    assert {k: v for k, v in got.items() if k in want} == {k: v for k, v in want.items() if a <= k[1] < c}
    assert all(v == [0, 0] for k, v in got.items() if k not in want)
    top = rollup.rollup_at(table(spark, rows), P0, ["*"]).agg(F.sum("total")).first()[0] or 0
    assert top == sum(t for _, f, t, _ in rows if f)


def test_time_bounds_reach_the_scan(spark):
    import contextlib
    import io

    from tidegrid.plans import adapters, catalog

    def filters(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return [x for x in out.getvalue().split("\n") if "PushedFilters" in x][0]

    sf = "/root/testdata/sf0.001"
    for name, column in (("fetch_exact", "ts"), ("fetch_lineitem", "l_shipdate"), ("fetch_region", "l_shipdate"), ("fetch_orders_month", "o_orderdate"), ("chunk_bounds", "ts"), ("chunks_flat", "ts")):
        read = filters(catalog.QUERIES[name](spark, sf))
        assert f"GreaterThanOrEqual({column}," in read and f"LessThan({column}," in read, (name, read)
    assert adapters.e1(spark, sf, ns_range(R, R, P0)).count() == 0


def test_stored_nanoseconds_reach_the_scan(spark, tmp_path):
    table(spark, [(i * D, ["a"], 1.0, 1.0) for i in range(5)]).write.parquet(f"{tmp_path}/events")
    span = ns_range(D, 2 * D, P0)
    cells = rollup.rollup_at(spark.read.parquet(f"{tmp_path}/events"), P0, ["a"], span)
    assert [r.epoch for r in cells.collect()] == [D]
    assert f"GreaterThanOrEqual(ts_ns,{D})" in cells._jdf.queryExecution().executedPlan().toString()

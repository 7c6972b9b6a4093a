"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tidegrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events"):
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in rows.fetchall()]
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)

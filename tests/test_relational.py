"""Every named query against DuckDB on the smallest tables."""

import duckdb
import pytest

from wavegrade.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in con.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want

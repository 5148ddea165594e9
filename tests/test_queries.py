"""Every query against its SQL over the smallest tables."""

import math
import os

import duckdb
import pytest

from quarrygraph.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=str)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)
    assert got

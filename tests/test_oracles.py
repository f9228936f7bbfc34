"""Each reference query against DuckDB on the small tables."""

import duckdb
import pytest

from lexloom.plans import catalogue
from lexloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(ORACLES[name])
    columns = [c[0] for c in r.description]
    assert set(columns) == set(df.columns)
    want = sorted((plain(x) for x in r.fetchall()), key=repr)
    got = sorted((plain(tuple(x[c] for c in columns)) for x in df.collect()), key=repr)
    assert got == want

"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from colloquy import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(plain(r[n]) for n in order) for r in data), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    got = catalog.queries()[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    if name not in catalog.oracle_sql():
        assert data
        return
    result = sql.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, data) == rows([c[0] for c in result.description], result.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).columns

"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import collections
import decimal
import glob
import math
import os

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 5) + 0.0
    return int(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, DATA).count() > 0

"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tailcast.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def close(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6))
    return str(x)[:10] == str(y)[:10] if hasattr(x, "year") else x == y


def order(rows):
    return sorted(rows, key=lambda r: [str(round(v, 3)) if isinstance(v, float) else str(v)[:10] for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = order([tuple(r[c] for c in names) for r in df.collect()])
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = order([tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()])
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(close, g, w))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())

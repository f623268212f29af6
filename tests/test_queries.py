"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
NAMES = sorted(k for k in entry.oracle_sql() if not k[0] == "p" or not k[1].isdigit() or k.startswith("p1_"))


def cell(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.8g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.sql(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, ROOT)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted(str([cell(r[c]) for c in order]) for r in got.collect())
    b = sorted(str([cell(r[k]) for k in at]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_unique_and_sql_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())

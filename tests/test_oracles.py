"""Every query with SQL gives the rows that DuckDB gives; every query runs."""

import datetime
import decimal
import glob
import math
import os

import __spark_entry__ as E
import duckdb
import pytest

QUERIES, SQL = E.queries(), E.oracle_sql()


def plain(value):
    """Values of both engines in one form."""
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(name, spark, data_dir, duck):
    got = QUERIES[name](spark, data_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = ordered([tuple(plain(r[c]) for c in columns) for r in got.collect()])
    right = ordered([tuple(map(plain, r)) for r in want.fetchall()])
    assert left == right


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_runs(name, spark, data_dir):
    assert QUERIES[name](spark, data_dir).collect() is not None

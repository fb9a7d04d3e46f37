"""Every SQL-checkable plan against its independent DuckDB twin (exact values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from renalytics.sources.tables import TABLES

from .conftest import ORACLE_SF

ORACLE = E.oracle_sql()
NAMES = sorted(ORACLE)


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ORACLE_SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_sql_twin(spark, duck, name):
    df = E.queries()[name](spark, ORACLE_SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 6 and sum(r["n_patients"] for r in rows) > 0

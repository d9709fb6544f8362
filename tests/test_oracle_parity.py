"""Every registered query against its DuckDB oracle (sf0.001, the driver's
gate runs the same at sf0.01).  Order-insensitive value comparison."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from fixture_paths import SF001
from ledgerlight.registry import REGISTRY

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


ORACLES = E.oracle_sql()


def test_every_reporting_query_has_an_oracle():
    assert sorted(REGISTRY) == sorted(set(ORACLES) & set(REGISTRY))


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(REGISTRY)))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    rows = df.collect()
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    key = sorted(cols)
    a = sorted(repr(tuple(_norm(r[cols.index(c)]) for c in key)) for r in rows)
    b = sorted(repr(tuple(_norm(r[ocols.index(c)]) for c in key)) for r in orows)
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert "quotesCompleteness" in df.columns


def test_report_order_is_level_then_value(spark):
    rows = E.queries()["report_order"](spark, SF001).collect()
    keys = [(r.level, -r.value) for r in rows]
    assert keys == sorted(keys)

"""Every registered query equals its DuckDB oracle on the smallest driver tables
(row count, column names, order-insensitive values)."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from studyhall.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KEYS = sorted(registry.queries())
SQL = registry.oracle_sql()
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, decimal.Decimal):
        return ("D", str(v.normalize()))
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_oracle():
    assert set(SQL) == set(KEYS)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = df.collect()
    cur = duck.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        assert dtypes[f.name] == TYPE_NAMES.get(s, s.upper()), (f.name, s, dtypes[f.name])
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(dcols, want)


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1
    doc = rows[0].asDict(recursive=True)
    assert doc["users"]["total"] == sum(doc["users"]["by_role"].values())

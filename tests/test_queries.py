"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from tracewright.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return db


def rows(records):
    show = lambda v: "-" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    out = QUERIES[name](spark, sf)
    cols = sorted(out.columns)
    kinds = {r[0]: r[1] for r in duck.execute("describe " + ORACLES[name]).fetchall()}
    assert {k: KINDS[v] for k, v in out.dtypes} == kinds
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLES[name]})").fetchall()
    assert rows(out.select(*cols).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL against DuckDB, values and all."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracewright.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(cell(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

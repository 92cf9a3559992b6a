"""Every query of the library against DuckDB on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF

from lodestone.plans import queries as plans
from lodestone.plans import answers, dashboard, focus, layout, layouts, lexical, planning, records, rules, search, sections, store, terms  # noqa: F401  they register their queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if getattr(v, "ndim", 0) or isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if pd.isna(v):
        return "null"
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.SQL:
        assert len(got)
        return
    want = duck.execute(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns

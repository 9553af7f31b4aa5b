"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")


def plain(v):
    if isinstance(v, list | tuple) or (hasattr(v, "tolist") and getattr(v, "ndim", 0)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return v if isinstance(v, bool) else round(float(v), 9) if isinstance(v, int | float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(map(plain, r))) for r in frame[cols].astype(object).values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {Path(f).stem} as select * from '{DATA}/{f}'")
    assert rows(entry.queries()[name](spark, str(DATA)).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 3

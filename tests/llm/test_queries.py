"""The queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from coalign.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, want = q.queries()[name](spark, SF_DIR).toPandas(), con.execute(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = "page_id" if "page_id" in got else "doc_id"
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else str(v)
    rows = lambda df: [tuple(cell(v) for v in r) for r in df[sorted(df.columns)].sort_values(key).itertuples(index=False)]
    assert rows(got) == rows(want)

"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from coalign.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows_of(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v != v else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SF_DIR).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["er_blocking_list"])
def test_match_list(spark, name):
    rows = registry.queries()[name](spark, SF_DIR).collect()
    ids = [r.source1_entity_id for r in rows]
    assert ids and len(ids) == len(set(ids))
    matched = [m for r in rows for m in r.matched_entity_ids.split(",") if m]
    assert len(matched) == len(set(matched)) and all(m[:2] in ("S2", "S3") for m in matched)

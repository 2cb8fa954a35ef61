"""Every core query with SQL against DuckDB on the test tables ($ORACLE_SF_DIR, sf0.001 unless set)."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from faultspark.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = tidy(QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(ORACLE_SQL[name]).df())
    assert len(got) and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)

"""Queries with SQL give the same rows as DuckDB on the smallest tables, and every query runs."""

import os

import duckdb
import pandas as pd
import pytest

from tilework.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = ["doc_id" if "doc_id" in cols else "conv_id"]
        a, b = (f[cols].sort_values(key).reset_index(drop=True) for f in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)

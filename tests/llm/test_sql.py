"""Queries of the subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest
from wardline.llm import queries

SF = os.environ.get("WARDLINE_TEST_SF", "/root/testdata/sf0.001")


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())

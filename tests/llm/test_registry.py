"""Operators with SQL give the same rows as DuckDB."""

import duckdb
import pytest

from lodestrata.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, want.select(order).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())

"""Corpus queries with SQL against DuckDB on the same tables."""

import pytest

from cairnwatch.llm import queries
from tests.test_oracle import TABLES, value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    assert left == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())

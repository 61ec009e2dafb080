"""Every registered query with SQL against DuckDB on the same tables."""

import math
import re
from pathlib import Path

import pytest

from cairnwatch.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    right = sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())
    assert left == right


def test_keys_and_columns(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
    assert all(re.fullmatch(r"[a-z0-9_]+", k) for k in e.queries())


def test_nothing_imports_the_corpus_operators():
    root = Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "cairnwatch.llm" not in f.read_text(), f

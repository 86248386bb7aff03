"""The queries that SQL can express, against DuckDB; and the entry module without a session."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from strataflow.llm.oracle import ORACLE_SQL
from strataflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry_needs_no_session():
    root = Path(__file__).resolve().parents[2]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); assert 'pipeline' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

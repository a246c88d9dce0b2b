"""Every analytics query against its DuckDB equivalent, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tallyforge import gates, workload

QUERIES, ORACLES = workload.queries() | gates.queries(), workload.oracle_sql() | gates.oracle_sql()
SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) == len(workload.queries()) + len(gates.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, str(SMALL))
    theirs = duck.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    rows = [tuple(map(str, r)) for r in ours.select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(map(str, r)) for r in theirs.fetchall())

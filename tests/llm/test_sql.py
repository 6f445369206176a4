"""The statements of the operators' queries on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tapeloom.llm import queries
from tools.check import rows_of

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for path in SF.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    df = queries.QUERIES[name](spark, str(SF))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(queries.ORACLES[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

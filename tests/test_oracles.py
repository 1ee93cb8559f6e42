"""Every core query against its SQL on DuckDB, on the smallest tables."""

from datetime import timezone
from pathlib import Path

import duckdb
import pytest

from quillmesh.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if getattr(v, "tzinfo", None):
        return v.astimezone(timezone.utc).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).iterdir():
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in df.columns]
    ours = sorted(repr(tuple(plain(x) for x in r)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in order)) for r in sql.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

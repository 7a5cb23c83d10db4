"""Every registered library query against its oracle SQL in DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from quern.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_rows_match(spark, duck, name):
    got = queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({oracle_sql()[name]}) q").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "hit_group", "score", "total_matches"]

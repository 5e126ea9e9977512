"""Every query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kgweft import queries as q


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, duck, data, name):
    df = q.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    told = duck.sql(q.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in told.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(q.queries()) == set(q.oracle_sql())

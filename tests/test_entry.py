"""Every query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in entry.core.ORACLES}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(cursor.description)}
    assert sorted(at) == columns
    theirs = sorted(tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs


def test_every_query_has_an_entry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.text is not None for r in rows)

"""Every query with SQL against DuckDB, on the smallest tables."""

from datetime import datetime
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == order
    wanted = Counter(plain([r[cols.index(c)] for c in order]) for r in cur.fetchall())
    assert Counter(plain([r[c] for c in order]) for r in df.collect()) == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

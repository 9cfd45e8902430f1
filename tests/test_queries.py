"""Every registered query with SQL gives the rows that DuckDB gives."""

import os
from pathlib import Path

import pandas as pd
import pytest

from talkweave.registry import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no shared tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["S", "updated_at", "turn_count", "message_count", "first_user_message"]
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query gives the rows of its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points
from crawlatlas.registry import QUERIES, SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    df = entry_points.queries()[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry_points.oracle_sql()[key])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())

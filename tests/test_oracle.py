"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from quire.oracle import ORACLE_SQL
from quire.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    want = sorted(repr(tuple(dict(zip(cols, r, strict=True))[c] for c in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == want


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

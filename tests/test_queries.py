"""Every core query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.incremental import queries as incremental
from lodestone.plans import registry

DATA = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")
QUERIES = registry.queries() | incremental.queries()
SQL = registry.oracle_sql() | incremental.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert canon(rows) == canon(tuple(r[i] for i in at) for r in got.fetchall())


def test_entry(spark):
    assert {"severity", "rule_id", "n"} == set(entry.entry(spark).columns)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

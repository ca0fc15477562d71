"""Every query over the fixture layers runs; those with SQL give what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from loamgrid.plans import queries as plans

#: Minutes long: run by the driver, and in small by test_pipeline.
SLOW = {"delineate"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - SLOW))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in plans.ORACLE_SQL:
        found = con.execute(plans.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(plans.QUERIES) >= 70

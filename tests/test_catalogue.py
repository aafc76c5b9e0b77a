"""Every query against its SQL on the smallest tables (where they are), and the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_entry_lists_every_query():
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship_runs(spark):
    assert 0 < entry.entry(spark).count() <= 4

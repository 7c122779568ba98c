"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return str(v) if v is None or isinstance(v, (list, dict)) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert cells(rows) == cells([tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall()])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spectroloom.plans.queries import QUERIES
from spectroloom.plans.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(same(r[i]) for i in at) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(list(found.columns), found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

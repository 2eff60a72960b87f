"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from linkspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def compare(spark, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = f(spark, SF)
    names = sorted(df.columns)
    con.execute(sql)
    known = [c[0] for c in con.description]
    assert sorted(known) == names
    theirs = sorted(tuple(plain(r[known.index(c)]) for c in names) for r in con.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())

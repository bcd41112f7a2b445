"""Every registered query with SQL gives the same rows, names and types as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from seamline import catalogue

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def connect():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql):
    df = query(spark, SF)
    rel = connect().sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    names = sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])

"""Every query with SQL gives the same rows in Spark and in DuckDB; the others give rows."""

import decimal
import math

import duckdb
import pytest

from tessella.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        at = [[d[0] for d in found.description].index(c) for c in names]
        assert len(found.description) == len(names)
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    else:
        assert got

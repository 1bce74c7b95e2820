"""Every query that has SQL agrees with it, on the smallest tables."""

import math
import os

import duckdb
import pytest

from qcloom.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return float(v) if v.__class__.__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    if name in Q.SQL:
        cur = duck.execute(Q.SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, cur.fetchall())
    else:
        assert got

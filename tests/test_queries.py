"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, (plain(r[i]) for i in order))) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in plans.ORACLES:
        assert df.columns and rows is not None
        return
    result = con.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), names)

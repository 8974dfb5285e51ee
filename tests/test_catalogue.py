"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from millrace.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=cols.__getitem__)

    def plain(x):
        if isinstance(x, decimal.Decimal):
            x = float(x)
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        return tuple(map(plain, x)) if isinstance(x, list) else x

    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if name not in catalogue.ORACLES:
        assert got[1]
        return
    cur = duck.execute(catalogue.ORACLES[name])
    assert got == _rows(cur.fetchall(), [d[0] for d in cur.description])
    assert got[1], "an empty result shows nothing"

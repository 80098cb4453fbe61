"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from glossia.jobs import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(queries.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def parsed_once():
    """The queries over parsed records share one parse here."""
    made, layout = {}, queries.layout
    queries.layout = lambda spark, sf_dir: made.setdefault(sf_dir, None) or made.update({sf_dir: layout(spark, sf_dir)}) or made[sf_dir]
    yield
    queries.layout = layout


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, parsed_once, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    found = duck.execute(queries.ORACLES[name])
    order = sorted(range(len(cols)), key=lambda i: found.description[i][0])
    assert [found.description[i][0] for i in order] == cols
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)

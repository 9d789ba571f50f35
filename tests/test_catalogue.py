import math

import duckdb
import pytest

from plumbline.plans import catalogue, oracles

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result SQL can't express; they have tests of their own.
WITHOUT_SQL = {"greedy_top_duplicates"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) - set(oracles.ORACLES) == WITHOUT_SQL and set(oracles.ORACLES) <= set(catalogue.QUERIES)


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)) or hasattr(v, "isoformat"):
        return str(v)
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(map(value, r)) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(map(value, r)) for r in want.fetchall()), key=str)

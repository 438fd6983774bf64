"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quern import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(names, values):
    tidy = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(tidy(v[k]) for k in sorted(range(len(names)), key=names.__getitem__)) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    r = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())

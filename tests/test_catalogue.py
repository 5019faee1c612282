"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidewell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(tidy(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())

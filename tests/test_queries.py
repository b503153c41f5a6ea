"""Every registered query of the library itself against its SQL on the small tables."""

import os

import pytest

from siltstone.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def catalogue():
    from dealscope.plans.catalogue import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def values(frame):
    cols = sorted(frame.columns)
    return sorted(tuple("null" if v is None or v != v else repr(round(float(v), 5)) if isinstance(v, float) else str(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables absent")
@pytest.mark.parametrize("name", catalogue())
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if (sql := entry.oracle_sql().get(name)) is None:
        assert len(got.columns)
        return
    expected = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got) == values(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables absent")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""The driver's contract on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def cells(rows, columns):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else v

    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_queries_equal_their_sql(spark):
    import duckdb

    from quillspan import catalogue

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    for name, sql in catalogue.ORACLE.items():
        got = catalogue.QUERIES[name](spark, DATA)
        result = con.sql(sql)
        assert sorted(got.columns) == sorted(result.columns), name
        columns = sorted(got.columns)
        mine = cells([r.asDict() for r in got.collect()], columns)
        theirs = cells([dict(zip(result.columns, r)) for r in result.fetchall()], columns)
        assert mine == theirs, name

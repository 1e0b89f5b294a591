"""Every query against its SQL on the smallest given tables."""

import os

import duckdb
import pytest

from checks.compare import TABLES, TYPES, rows_of
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE[name])
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    assert dict(df.dtypes) == kinds
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())

import duckdb
import pytest

from claimsweep.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    theirs = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(
        str(tuple(r[i] for i in order)) for r in theirs.fetchall())
